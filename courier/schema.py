"""Fixed table schemas shared by the operators."""

from pyspark.sql import types as T

# One file or object of a tree or a bucket listing.
INVENTORY = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("length", T.LongType(), True),
    T.StructField("is_link", T.BooleanType(), True),
    T.StructField("modified", T.TimestampNTZType(), True),
])

INVENTORY_WITH_CONTENT = T.StructType(INVENTORY.fields + [T.StructField("content", T.BinaryType(), True)])

# One write of one owner's bundle under a key.
DELIVERIES = T.StructType([
    T.StructField("bucket", T.StringType(), True),
    T.StructField("prefix", T.StringType(), True),
    T.StructField("course", T.StringType(), True),
    T.StructField("folder", T.StringType(), True),
    T.StructField("owner", T.StringType(), True),
    T.StructField("key", T.StringType(), True),
    T.StructField("uri", T.StringType(), True),
    T.StructField("length", T.LongType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("delivery_id", T.LongType(), True),
])

# Settings in long form: one row per (scope, name, layer).
SETTINGS = T.StructType([
    T.StructField("scope", T.StringType(), True),
    T.StructField("name", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
    T.StructField("layer", T.IntegerType(), False),
    T.StructField("secret", T.BooleanType(), True),
])

# One bounded archive of one owner's folder.
BUNDLES = T.StructType([
    T.StructField("owner", T.StringType(), True),
    T.StructField("folder", T.StringType(), True),
    T.StructField("part", T.LongType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("archive", T.BinaryType(), True),
    T.StructField("n_files", T.LongType(), True),
    T.StructField("bytes", T.LongType(), True),
])

# The same, written as a file.
STAGED = T.StructType([*BUNDLES.fields[:4], T.StructField("staged", T.StringType(), True),
                       T.StructField("compressed", T.LongType(), True), *BUNDLES.fields[5:]])

# One member restored from an archive.
MEMBERS = T.StructType([
    T.StructField("owner", T.StringType(), True),
    T.StructField("folder", T.StringType(), True),
    T.StructField("part", T.LongType(), True),
    T.StructField("path", T.StringType(), True),
    T.StructField("content", T.BinaryType(), True),
    T.StructField("length", T.LongType(), True),
    T.StructField("kind", T.StringType(), True),
    T.StructField("mode", T.IntegerType(), True),
    T.StructField("link_target", T.StringType(), True),
    T.StructField("_error", T.StringType(), True),
])
