"""Fixed schemas of every table the jobs read or write.

A pincode is always data in a row, never part of a column name. A product key
is opaque: every job takes the type that its tables hold (BIGINT here, text as
well), the streaming schema being a parameter.
"""

from pyspark.sql import types as T

# Seller offers, flat form: one row per offer; `zone` is the partition column.
OFFERS = T.StructType([
    T.StructField("zone", T.StringType()),
    T.StructField("product", T.LongType()),
    T.StructField("pincodeNum", T.IntegerType()),
    T.StructField("buyingPrice", T.IntegerType()),
    T.StructField("sellingPrice", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
])

# The nested value of an offer document.
LEAST_PRICE = T.StructType([
    T.StructField("pincodeNum", T.IntegerType()),
    T.StructField("buyingPrice", T.IntegerType()),
    T.StructField("sellingPrice", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
])

# Offers in document form: zone, product and a nested leastPrice struct.
OFFER_DOCUMENTS = T.StructType([
    T.StructField("zone", T.StringType()),
    T.StructField("product", T.LongType()),
    T.StructField("leastPrice", LEAST_PRICE),
])

PINCODES = T.StructType([
    T.StructField("pincode", T.IntegerType()),
    T.StructField("zone", T.StringType()),
])

DISTANCES = T.StructType([
    T.StructField("sourcePincode", T.IntegerType()),
    T.StructField("destPincode", T.IntegerType()),
    T.StructField("distance", T.DoubleType()),
])

PRODUCTS = T.StructType([
    T.StructField("product", T.LongType()),
])

# Long form of the per-product `prices` object: one row per (product, pincode).
PRODUCT_PRICES = T.StructType([
    T.StructField("product", T.LongType()),
    T.StructField("pincode", T.IntegerType()),
    T.StructField("price", T.LongType()),
    T.StructField("quantity", T.IntegerType()),
])

QUOTES = T.StructType([
    T.StructField("product", T.LongType()),
    T.StructField("zone", T.StringType()),
    T.StructField("pincode", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("price", T.DoubleType()),
])

# Key-value export of the distance table; both columns are text.
DISTANCE_KV = T.StructType([
    T.StructField("src_dest", T.StringType()),
    T.StructField("distance", T.StringType()),
])

REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("product", T.LongType()),
    T.StructField("zone", T.StringType()),
    T.StructField("dest_pin", T.IntegerType()),
])

# Result of price a table of requests (kind 'pin' -> one row, kind 'zone'
# -> one row per pincode of the zone; quantity is only known for 'zone').
REQUEST_PRICES = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("product", T.LongType()),
    T.StructField("zone", T.StringType()),
    T.StructField("pincode", T.IntegerType()),
    T.StructField("price", T.LongType()),
    T.StructField("quantity", T.IntegerType()),
])
