"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives Python workers this package, once an application, where it isn't installed on the executors."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        home = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="filigraph-ship-")) / "filigraph_package.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(home.rglob("*.py")):
                out.write(path, path.relative_to(home.parent).as_posix())
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A session on this machine, for tests and small inputs."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("filigraph")
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | settings
    return ship(builder.config(map=conf).getOrCreate())
