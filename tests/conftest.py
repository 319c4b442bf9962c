import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from cardwarden.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        spark__master="local[8]",
        spark__driver__memory="6g",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def raw_rows(spark):
    """Hand-written raw transactions: both time formats, missing fields, bad numbers."""
    from cardwarden.schemas import RAW_TXN

    base = {
        "trans_date_trans_time": "2020-05-06 00:07:08", "cc_num": "3000000000000000017",
        "merchant": "fraud_Lantern and Oak", "category": "books",
        "amt": "20.25", "first": "Ada", "last": "Quill", "gender": "M", "zip": "1234",
        "lat": "10.5", "long": "-20.25", "city_pop": "5000",
        "job": "Potter", "dob": "1991-02-03", "trans_num": "a",
        "unix_time": "1588723628", "merch_lat": "11.5", "merch_long": "-21.75",
        "is_fraud": "0",
    }
    rows = [
        base,
        {**base, "trans_num": "b", "trans_date_trans_time": "2021-08-09T10:11:12.345Z",
         "category": "music", "gender": "F", "dob": "1985-06-07", "amt": "3000", "job": None},
        {**base, "trans_num": "c", "amt": "abc", "is_fraud": "1", "category": "travel"},
        {**base, "trans_num": "d", "dob": None, "zip": "12x", "cc_num": "42"},
    ]
    names = RAW_TXN.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_TXN)
