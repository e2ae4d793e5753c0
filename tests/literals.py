"""Fixed inputs and the results they must give."""

import json

from pyspark.sql import functions as F

from tidewell.sources import products

EXPANSIONS = [("ip 14prm", "iphone 14 pro max"), ("ss galaxy", "samsung galaxy"), ("dt", "điện thoại"), ("256gb", "256 gb"), ("macbook air m2", "macbook air m 2"),
              ("samsung galaxy s24", "samsung galaxy s 24"), ("tai_nghe", "tai nghe"), ("---", "---"), ("MTB ip", "máy tính bảng iphone")]
JUNK = [("-24%", True), ("123.000đ", True), ("123", True), ("99,000 vnd", True), ("iPhone 15", False), ("", False)]
CATEGORIES = [("A > B > C", "A|B|C"), ("wi-fi", "wi|fi"), ("a / b - c", "a|b - c"), (" x ", "x"), ("", ""), ("a>b", "a|b")]
EBAY_PRICES = [("$1,200.00", 1200.0), ("1.000.000", 1000.0), ("", 0.0), ("US $12.5 to $20", 12.5), ("free", 0.0)]
EBAY_IDS = [("https://www.ebay.com/itm/123/x?y=1", "123"), ("https://www.ebay.com/itm/456?z", "456")]
RECORDS = [
    ({"id": "1", "title": "A", "price": 12.5, "platform": "Tiki", "category": ["x", "y"]}, ("tiki_1", "A", 12, 12, 0, "tiki", "x > y")),
    ({"id": "shopee_2", "name": "B", "price": "18.990.000 d", "list_price": "20.000.000", "source": "shopee", "sold_count": 3}, ("shopee_2", "B", 18990000, 20000000, 3, "shopee", "")),
    ({"id": "3", "subject": "C", "price": "1.299.000 - 2.000.000", "all_time_quantity_sold": 7}, ("3", "C", 1299000, 1299000, 7, "", "")),
    ({"id": "4", "title": "", "price": 1}, None),
    ({"id": 5, "title": "E", "platform": "tiki"}, None),
    ({"id": "6", "title": "F", "sold_count": "1.2k"}, None),
]
TIKI = ({"id": 9, "name": "Pan", "price": 50000, "list_price": 70000, "quantity_sold": {"value": 4}, "url_path": "pan.html", "brand_name": ""}, ("tiki_9", "Pan", 50000, 70000, 4, "https://tiki.vn/pan.html"))
CHOTOT = ({"subject": "Old\nbike", "price": 900, "company_ad": False}, ("chotot_None", "Old bike", 900, 900, 0, "https://www.chotot.com/None.htm"))
SHOPEE = (("https://shopee.vn/a-b-i.12.34?x=1", ["Mall", "Case", "₫1.000 - ₫2.000", "Đã bán 1,2k"]), ("shopee_12.34", "Case", 1000, 1000, 12000, "https://shopee.vn/a-b-i.12.34"))
EBAY = ('<li><a class="s-item__link" href="https://www.ebay.com/itm/77?h=1"><div class="s-item__title">Lens <b>50mm</b></div></a><span class="s-item__price">$1,200.00</span><img src="i.jpg">100+ sold</li>',
        ("ebay_77", "Lens50mm", 1200, 1200, 100, "https://www.ebay.com/itm/77"))
PARSED = ["id", "title", "price", "original_price", "sold_count", "link"]


def variants(spark, records):
    lines = [(json.dumps(r), 0, n) for n, r in enumerate(records)]
    return spark.createDataFrame(lines, "value string, src_ord int, pos long").withColumn("v", F.try_parse_json("value"))


def normalized(spark):
    found = products.normalized(variants(spark, [r for r, _ in RECORDS])).where("valid")
    return found.select("id", "title", "price", "original_price", "sold_count", "platform", "category")


def parsed(spark):
    tiki = variants(spark, [TIKI[0]]).select(products.parse_tiki(F.col("v")).alias("product"))
    chotot = variants(spark, [CHOTOT[0]]).select(products.parse_chotot(F.col("v")).alias("product"))
    shopee = spark.createDataFrame([SHOPEE[0]], "link string, lines array<string>").select(products.parse_shopee(F.col("link"), F.col("lines")).alias("product"))
    ebay = products.parse_ebay(spark.createDataFrame([(EBAY[0],)], "html string"), "html", F.lit("lens")).select("product")
    return tiki.unionByName(chotot).unionByName(shopee).unionByName(ebay).select("product.*").select(*PARSED)
