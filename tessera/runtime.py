"""Getting the package to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a folder under the machine's temporary one is chosen and set if all of Spark runs in one
    process there, as in tests; on a cluster that is an error, as executors don't share such a folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all machines share")
        at = f"file://{tempfile.gettempdir()}/tessera-scratch-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the session's executors, once for each application.

    Python workers import it from there where it isn't installed. A package that is itself read from an archive was
    sent by other means, and is left alone.
    """
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    if context.applicationId in _sent or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))  # the driver serves it for as long as the session lives
    _sent.add(context.applicationId)
