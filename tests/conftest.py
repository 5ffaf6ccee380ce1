import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomstone.session import local_session  # noqa: E402

_spark = local_session("4", 4)  # before the test modules, which name columns


@pytest.fixture(scope="session")
def spark():
    return _spark


@pytest.fixture(scope="session")
def odd_tables(spark, tmp_path_factory):
    """Folders with the test tables empty, and with rows of nothing but nulls; None where there are no test tables."""
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        return None
    from pyspark.sql import functions as F

    folders = {}
    for kind in ("empty", "null"):
        folders[kind] = str(tmp_path_factory.mktemp(kind))
        for f in os.listdir(data):
            df = spark.read.parquet(f"{data}/{f}").limit(2 if kind == "null" else 0)
            if kind == "null":
                df = df.select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
            df.coalesce(1).write.parquet(f"{folders[kind]}/{f}")
    return folders
