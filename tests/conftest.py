import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 6g --conf spark.ui.enabled=false pyspark-shell")

from kinfold.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def raw_batch(spark):
    """Twelve raw rows, out of order, that meet every cleaning rule; see ``test_cleaning.py`` for what becomes of them."""
    rows = [
        ("m08", "Ola Nordmann", "no-at-sign", 33, "NO", "1/2/2022", 0.8, "kr 99"),
        ("m05", "Sanna Lehto", "sanna@post.test", 28, "FI", "2022-05-06", 0.1, "8"),
        ("m10", "Bo", "bo@post.test", 61, "DK", "2022-01-02 03:04:05", 0.4, "$1,000,000.01"),
        ("m01", "PETRA vom BERG", "petra@post.test", 30, "de ", "28-02-2022", 0.5, "1500 €"),
        ("m03", " ", "blank@post.test", 19, "PL", "03/25/2022", 0.9, "-45.5"),
        ("m12", "Zoe Berg", "zoe@post.test", 38, None, "", 0.6, "12.50.75"),
        ("m09", None, None, None, None, None, None, None),
        ("m07", "Sanna Lehtonen", "sl@post.test", 51, "SE", "29/02/2023", 0.3, None),
        ("m04", "sanna lehto", "Sanna@Post.test ", 27, "FI", "2022-05-06T07:08:09+0300", 0.1, "7"),
        ("m02", "Ivo Horak", "ivo@post.test", 44, "\tcz", "2022-13-01", 0.2, "¥ 12,000"),
        ("m11", "Ob", "ob@post.test", 62, "DK", "2022-12-31", 0.4, "€ -3"),
        ("m06", "Sana Lehto", "other@post.test", None, "FI", None, None, "£.5"),
    ]
    return spark.createDataFrame(rows, "id string, name string, email string, age bigint, country string, joined_at string, score double, salary string")
