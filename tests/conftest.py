import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfline.session import build_session  # noqa: E402
from shelfline.sources import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return datetime.date.fromisoformat(text)


@pytest.fixture(scope="session")
def make(spark):
    """Rows of a canonical table from dicts; columns not given are null."""
    def build(table, *rows, partitions=None):
        schema = schemas.TABLES[table]
        full = [tuple(_value(f, row.get(f.name)) for f in schema.fields) for row in rows]
        df = spark.createDataFrame(full, schema)
        return df.repartition(partitions) if partitions else df
    return build


def _value(field, value):
    kind = field.dataType.simpleString()
    if value is None:
        return None
    if kind == "date":
        return day(value)
    if kind.startswith("decimal"):
        import decimal
        return decimal.Decimal(str(value))
    return float(value) if kind == "double" else value


@pytest.fixture(scope="session")
def sales(make):
    """Transactions from (id, store, date, amount) with optional overrides."""
    def build(*rows, **common):
        out = []
        for r in rows:
            base = dict(zip(("transaction_id", "store_id", "transaction_date", "total_amount"), r[:4]),
                        status="COMPLETED", loyalty_card=False, payment_method="CASH")
            base.update(common)
            if len(r) > 4:
                base.update(r[4])
            out.append(base)
        return make("transactions", *out)
    return build


def rows(df, *cols):
    df = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
