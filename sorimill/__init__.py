"""A text engine on Spark: written Korean to speech, and training text at scale."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Send this package to the executors of a running session that doesn't have it.

    Operators that work in Arrow batches import it there. Not needed where it is
    installed, or given with --py-files.
    """
    root = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:  # on the driver only; Spark copies the file
        path = os.path.join(folder, "sorimill.zip")
        with zipfile.ZipFile(path, "w") as out:
            for at, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(at, name)
                        out.write(full, os.path.join("sorimill", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
