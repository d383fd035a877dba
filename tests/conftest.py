import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


RAW = """facility_id string, name string, address_state string, address_city string,
 address_zip string, latitude double, longitude double, facilityTypeId string,
 specialties string, procedure string, equipment string, capability string,
 description string, numberDoctors string, capacity string, recency_of_page_update string,
 social_count int, model_reply string"""


@pytest.fixture(scope="session")
def raw_rows(spark):
    """Raw facilities from keyword records; everything not named is missing."""
    names = [c.split()[0] for c in RAW.replace("\n", " ").split(",")]

    def build(*records):
        rows = [tuple({"facility_id": f"{i:05d}", "name": f"F{i}", **r}.get(n) for n in names)
                for i, r in enumerate(records)]
        return spark.createDataFrame(rows, RAW)

    return build
