import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def samples(tmp_path_factory):
    """The folder of sample drawings and specifications, and their manifests by drawing."""
    from drawing_samples import write_samples

    folder = tmp_path_factory.mktemp("samples")
    return folder, {m["id"]: m for m in write_samples(folder)}


@pytest.fixture(scope="session")
def facts(spark, samples):
    from plumbline.operators.planner import Facts
    from plumbline.sources import dxf
    from plumbline.staging import stage

    parsed = stage(dxf.read_dxf(spark, str(samples[0] / "drawings"), "FAILFAST"), "parsed")
    return Facts(stage(dxf.entities(parsed), "entities"), stage(dxf.drawings(parsed), "sheets"))
