"""Settings and documents: layered resolution, redaction, nested lookups, endpoints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.endpoints import DEFAULT_PORT, host, port, url_authority
from ..functions.nested import lookup

# Fixed values, one line per setting: name, environment variable, default, secret, whether a program
# may override it.
CATALOGUE = (
    ("kafka_bootstrap", "KAFKA_BOOTSTRAP_SERVERS", "localhost:9092", False, True),
    ("schema_registry_url", "SCHEMA_REGISTRY_URL", "", False, True),
    ("flink_rest_url", "FLINK_REST_URL", "", False, True),
    ("kafka_sasl_username", "KAFKA_SASL_USERNAME", "", False, True),
    ("kafka_sasl_password", "KAFKA_SASL_PASSWORD", "", True, True),
    ("jupyterhub_user", "JUPYTERHUB_USER", "", False, False),
    ("course", "COURSE_NAME", "", False, True),
    ("github_branch", "GITHUB_BRANCH", "", False, False),
    ("github_repo", "GITHUB_REPO", "", False, False),
    ("aws_region", "AWS_DEFAULT_REGION", "", False, True),
    ("aws_access_key_id", "AWS_ACCESS_KEY_ID", "", True, True),
    ("aws_secret_access_key", "AWS_SECRET_ACCESS_KEY", "", True, True),
)
DEFAULTS = {name: default for name, _, default, _, _ in CATALOGUE}
SECRETS = tuple(name for name, _, _, secret, _ in CATALOGUE if secret)
CREDENTIAL_PAIR = ("aws_access_key_id", "aws_secret_access_key")

# Layer numbers: lower wins.
OVERRIDE, ENV, FILE = 0, 1, 2


def layered_settings(layers: DataFrame, defaults=None, *, scope_col: str = "scope",
                     name_col: str = "name", value_col: str = "value", layer_col: str = "layer",
                     skip_blank_layers: Sequence[int] = (OVERRIDE,)) -> DataFrame:
    """Resolve every (scope, name) from ordered layers (lower ``layer`` wins).

    * ``resolved``: the first layer with a value, where a blank value counts as absent only in
      ``skip_blank_layers`` (an override left blank falls through, an environment variable set to
      blank wins over the default); the default when no layer has one.
    * ``effective``: the first non-blank value of any layer, else the default.
    * ``source``: the layer that gave ``resolved`` (NULL = default).

    One grouped aggregate (``min_by`` over the counting rows), pre-aggregated on the map side. The
    default catalogue (a mapping) becomes a map literal; a DataFrame of defaults is joined.
    """
    v, lay = F.col(value_col), F.col(layer_col)
    counts = v.isNotNull() & ((v != "") | ~lay.isin(*skip_blank_layers)) if skip_blank_layers else v.isNotNull()
    nonblank = v.isNotNull() & (v != "")
    agg = layers.groupBy(scope_col, name_col).agg(
        F.min_by(F.when(counts, v), F.when(counts, lay)).alias("_resolved"),
        F.min(F.when(counts, lay)).alias("source"),
        F.min_by(F.when(nonblank, v), F.when(nonblank, lay)).alias("_effective"))
    if defaults is None:
        defaults = DEFAULTS
    if isinstance(defaults, Mapping):
        # a mapping is the program's own text: a map literal looked up per row, no join at all
        lookup_map = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
        out = agg.withColumn("_default", F.try_element_at(lookup_map, F.col(name_col)))
    else:
        ddf = defaults.toDF("_dname", "_default")
        out = agg.join(ddf, agg[name_col] == ddf["_dname"], "left")
    return out.select(scope_col, name_col,
                      F.coalesce("_resolved", "_default").alias("resolved"),
                      F.coalesce("_effective", "_default").alias("effective"),
                      "source")


def credential_pairs(resolved: DataFrame, key_name: str = CREDENTIAL_PAIR[0],
                     secret_name: str = CREDENTIAL_PAIR[1], *, scope_col: str = "scope",
                     name_col: str = "name", value_col: str = "effective") -> DataFrame:
    """Per scope: is a key/secret pair usable? Both halves are resolved independently (they may come
    from different layers) and count only together; otherwise the default credential chain applies.
    Returns ``(scope, has_key, has_secret, complete)``, never the values themselves."""
    v = F.col(value_col)
    present = v.isNotNull() & (v != "")
    agg = (resolved.where(F.col(name_col).isin(key_name, secret_name))
           .groupBy(scope_col)
           .agg(F.max(F.when(F.col(name_col) == key_name, present)).alias("has_key"),
                F.max(F.when(F.col(name_col) == secret_name, present)).alias("has_secret")))
    has_key = F.coalesce(F.col("has_key"), F.lit(False))
    has_secret = F.coalesce(F.col("has_secret"), F.lit(False))
    return agg.select(scope_col, has_key.alias("has_key"), has_secret.alias("has_secret"),
                      (has_key & has_secret).alias("complete"))


def redact_presence(df: DataFrame, secret_cols: Sequence[str], *, rename: Mapping[str, str] | None = None,
                    blank_to_null: bool = True) -> DataFrame:
    """Never show a secret, only whether it is there: each secret column becomes the BOOLEAN
    ``has_<col>`` (= not NULL and not blank); other text columns turn blanks into NULL.

    Names compare without case, as Spark's do; a secret that names no column raises, so that a
    misspelt name cannot leave a secret in clear."""
    rename = dict(rename or {})
    types = dict(df.dtypes)
    secrets = {c.lower() for c in secret_cols}
    unknown = secrets - {c.lower() for c in df.columns}
    if unknown:
        raise ValueError(f"no such secret columns: {sorted(unknown)}")
    cols = []
    for c in df.columns:
        if c.lower() in secrets:
            cols.append((F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(rename.get(c, f"has_{c}")))
        elif blank_to_null and types[c] == "string":
            cols.append(F.nullif(F.col(c), F.lit("")).alias(rename.get(c, c)))
        else:
            cols.append(F.col(c).alias(rename.get(c, c)))
    return df.select(*cols)


def settings_report(resolved: DataFrame, *, scope_col: str = "scope", name_col: str = "name",
                    value_col: str = "effective", names=None, secrets=SECRETS) -> DataFrame:
    """One row per scope with every setting as a column, the way a diagnosis shows them: plain
    settings as values (blank → NULL; a setting no layer mentions takes its default), secrets only as
    ``has_<name>`` flags — no secret text in any cell. ``credentials`` says where a scope's key pair
    comes from: ``source`` if both halves are set, else ``default-chain``. One grouped pivot over the
    fixed catalogue (explicit values: no extra job to find them)."""
    names = list(names or DEFAULTS)
    wide = (resolved.where(F.col(name_col).isin(*names))
            .groupBy(scope_col).pivot(name_col, names).agg(F.first(value_col, ignorenulls=True)))
    # a setting no layer mentions for a scope has its catalogue default
    wide = wide.select(scope_col, *[F.coalesce(F.col(n), F.lit(DEFAULTS.get(n))).alias(n) for n in names])
    known = [n for n in names if n in secrets]
    pair = [n for n in CREDENTIAL_PAIR if n in names]
    if len(pair) < 2:
        return redact_presence(wide, known)
    both = F.lit(True)
    for n in pair:
        both = both & F.col(n).isNotNull() & (F.col(n) != "")
    wide = wide.withColumn("credentials", F.when(F.coalesce(both, F.lit(False)), "source").otherwise("default-chain"))
    return redact_presence(wide, known)


def nested_lookup(df: DataFrame, doc_col: str, dotted_path: str, type_: str = "variant", *,
                  strict: bool = False, out: str | None = None) -> DataFrame:
    """Value at a dotted path of a JSON document column (``a.b`` → ``$['a']['b']``, no escaping of
    dots). Missing → NULL, or an error with ``strict=True``. ``type_`` casts the leaf; ``variant``
    keeps a subtree."""
    return df.withColumn(out or dotted_path.split(".")[-1], lookup(doc_col, dotted_path, type_, strict=strict))


def endpoints(df: DataFrame, col: str, default_port: int = DEFAULT_PORT, *, url: bool = False) -> DataFrame:
    """``host`` and ``port`` (INT; missing or empty → default, not a number → NULL) of every endpoint.

    A ``host:port`` column may hold a comma-separated broker list (one row per broker); with
    ``url=True`` the column holds URLs and the authority (``host[:port]``, user info dropped) is used.
    """
    if url:
        out = df.withColumn("_ep", url_authority(F.col(col)))
    else:
        out = df.withColumn("_ep", F.explode(F.split(F.col(col), ","))).withColumn("_ep", F.trim("_ep"))
    out = out.where(F.col("_ep") != "")
    return (out.withColumn("host", host(F.col("_ep")))
               .withColumn("port", port(F.col("_ep"), default_port)).drop("_ep"))


def endpoint_inventory(df: DataFrame, col: str, default_port: int = DEFAULT_PORT, *,
                       url: bool = False) -> DataFrame:
    """How many times each (host, port) is named (partial + final hash aggregate)."""
    return (endpoints(df.select(col), col, default_port, url=url)
            .groupBy("host", "port").agg(F.count(F.lit(1)).alias("n")))
