"""Session settings and the shared folder for written intermediates."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "reviewloom", **conf: str) -> SparkSession:
    """Session for tests and the bench. On a cluster, bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix=f"{app}-"))
    )
    return builder.config(map=conf).getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder ``spark.checkpoint.dir`` names.

    Only a local-mode session may lack that setting; its intermediates then lie in a folder named
    after the application below the machine's temporary one.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        root = f"{tempfile.gettempdir()}/reviewloom-{spark.conf.get('spark.app.id')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
