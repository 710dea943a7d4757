"""Record layout and label map of the network-flow table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from skewlens.session import local_table

# Column names and types of a record, in file order.
RECORD_FIELDS = [
    ("duration", T.LongType()),
    ("protocol_type", T.StringType()),
    ("service", T.StringType()),
    ("flag", T.StringType()),
    ("src_bytes", T.LongType()),
    ("dst_bytes", T.LongType()),
    ("land", T.LongType()),
    ("wrong_fragment", T.LongType()),
    ("urgent", T.LongType()),
    ("hot", T.LongType()),
    ("num_failed_logins", T.LongType()),
    ("logged_in", T.LongType()),
    ("num_compromised", T.LongType()),
    ("root_shell", T.LongType()),
    ("su_attempted", T.LongType()),
    ("num_root", T.LongType()),
    ("num_file_creations", T.LongType()),
    ("num_shells", T.LongType()),
    ("num_access_files", T.LongType()),
    ("num_outbound_cmds", T.LongType()),
    ("is_host_login", T.LongType()),
    ("is_guest_login", T.LongType()),
    ("count", T.LongType()),
    ("srv_count", T.LongType()),
    ("serror_rate", T.DoubleType()),
    ("srv_serror_rate", T.DoubleType()),
    ("rerror_rate", T.DoubleType()),
    ("srv_rerror_rate", T.DoubleType()),
    ("same_srv_rate", T.DoubleType()),
    ("diff_srv_rate", T.DoubleType()),
    ("srv_diff_host_rate", T.DoubleType()),
    ("dst_host_count", T.LongType()),
    ("dst_host_srv_count", T.LongType()),
    ("dst_host_same_srv_rate", T.DoubleType()),
    ("dst_host_diff_srv_rate", T.DoubleType()),
    ("dst_host_same_src_port_rate", T.DoubleType()),
    ("dst_host_srv_diff_host_rate", T.DoubleType()),
    ("dst_host_serror_rate", T.DoubleType()),
    ("dst_host_srv_serror_rate", T.DoubleType()),
    ("dst_host_rerror_rate", T.DoubleType()),
    ("dst_host_srv_rerror_rate", T.DoubleType()),
    ("label", T.StringType()),
    ("difficulty", T.LongType()),
]

# Columns that are categories, and columns that are not features.
CATEGORICAL = ["protocol_type", "service", "flag"]
NOT_FEATURES = ["label", "difficulty", "category"]

# Category of every record label.
CATEGORY_OF = {
    "normal": "Normal",
    "back": "DoS",
    "land": "DoS",
    "neptune": "DoS",
    "pod": "DoS",
    "smurf": "DoS",
    "teardrop": "DoS",
    "apache2": "DoS",
    "udpstorm": "DoS",
    "processtable": "DoS",
    "mailbomb": "DoS",
    "ipsweep": "Probe",
    "nmap": "Probe",
    "portsweep": "Probe",
    "satan": "Probe",
    "mscan": "Probe",
    "saint": "Probe",
    "ftp_write": "R2L",
    "guess_passwd": "R2L",
    "imap": "R2L",
    "multihop": "R2L",
    "phf": "R2L",
    "spy": "R2L",
    "warezclient": "R2L",
    "warezmaster": "R2L",
    "sendmail": "R2L",
    "named": "R2L",
    "snmpgetattack": "R2L",
    "snmpguess": "R2L",
    "xlock": "R2L",
    "xsnoop": "R2L",
    "worm": "R2L",
    "buffer_overflow": "U2R",
    "loadmodule": "U2R",
    "perl": "U2R",
    "rootkit": "U2R",
    "httptunnel": "U2R",
    "ps": "U2R",
    "sqlattack": "U2R",
    "xterm": "U2R",
}

# Rows wanted of the two rare classes after augmentation.
AUGMENT_TARGETS = {"R2L": 5000, "U2R": 500}


def record_schema() -> T.StructType:
    """The layout as a schema; needs no running session."""
    return T.StructType([T.StructField(name, kind) for name, kind in RECORD_FIELDS])


def label_dim(spark: SparkSession) -> DataFrame:
    """(label, category)."""
    return local_table(spark, list(CATEGORY_OF.items()), "label string, category string")
