import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from labelspark.session import ship_package

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def own_index(spark):
    from pyspark.sql import functions as F

    from labelspark.operators import retrieval
    from labelspark.sources import documents

    corpus = documents.default_corpus(spark).withColumn("doc_id", F.col("ordinal").cast("long"))
    return retrieval.build_index(corpus)
