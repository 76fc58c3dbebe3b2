"""Fixed schemas of the six canonical tables; nothing is inferred from the files."""

from pyspark.sql import types as T

_S, _D, _B = T.StringType(), T.DateType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


TRANSACTIONS = _schema(
    ("transaction_id", _S), ("store_id", _S), ("customer_id", _S), ("transaction_date", _D),
    ("total_amount", T.DecimalType(18, 2)), ("status", _S), ("payment_method", _S), ("loyalty_card", _B))

TRANSACTION_ITEMS = _schema(
    ("transaction_item_id", _S), ("transaction_id", _S), ("item_id", _S), ("quantity", T.IntegerType()),
    ("unit_price", T.DoubleType()), ("was_on_promo", _B))

STORES = _schema(
    ("store_id", _S), ("store_name", _S), ("country", _S), ("city", _S), ("format", _S), ("region", _S),
    ("size_sqm", T.IntegerType()), ("opening_date", _D))

PRODUCTS = _schema(
    ("item_id", _S), ("item_name", _S), ("brand", _S), ("category", _S), ("department", _S),
    ("vendor_id", _S), ("cost", T.DoubleType()))

VENDORS = _schema(
    ("vendor_id", _S), ("vendor_name", _S), ("country", _S), ("tier", _S), ("is_shared_catalog", _B))

STORE_PROMOTIONS = _schema(
    ("store_id", _S), ("promo_name", _S), ("variant", _S), ("promo_type", _S),
    ("start_date", _D), ("end_date", _D))

TABLES = {
    "transactions": TRANSACTIONS,
    "transaction_items": TRANSACTION_ITEMS,
    "stores": STORES,
    "products": PRODUCTS,
    "vendors": VENDORS,
    "store_promotions": STORE_PROMOTIONS,
}

# Columns that no operator needs: files may lack them.
OPTIONAL = {
    "stores": {"store_name", "city", "region"}, "products": {"item_name", "brand", "department"},
    "vendors": {"country", "is_shared_catalog"}, "store_promotions": {"promo_type"}}

# The hourly feed: a flattened sale line with the header columns.
STAGING = T.StructType(
    TRANSACTION_ITEMS.fields
    + [f for f in TRANSACTIONS.fields if f.name != "transaction_id"]
    + [T.StructField("_ingested_at", T.TimestampType(), True)])
