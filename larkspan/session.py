"""Session construction and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def build_session(app: str = "larkspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` overrides any setting."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views of the named tables, so that SQL text can use them."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


_SHIPPED: set[str] = set()


#: Rows and bytes of one Arrow batch to Python, where the session says nothing: whole texts can be long.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> SparkSession:
    """Give Python workers this package, once per application, so that it need not be installed on executors.

    Arrow batches get the bounds of ARROW_BATCH unless the application has its own.
    """
    import tempfile
    import zipfile
    from pathlib import Path

    for k, v in ARROW_BATCH.items():
        if not spark.sparkContext.getConf().contains(k):
            spark.conf.set(k, v)
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="larkspan-")) / "larkspan_pkg.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)
    return spark
