"""Raw marketplace records to canonical products.

Records come as a variant column ``v``. What a record lacks to be valid is not raised: rejected records can be had
beside the products.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import clean_price_text, ebay_id, ebay_price, first_filled, or_empty, product_id, strip
from tidewell.operators.dedup import keep_first
from tidewell.sources.jsonl import PRODUCT


def text(v: Column, name: str) -> Column:
    """A field as text; null if it is absent or null."""
    return F.try_variant_get(v, f"$.{name}", "string")


def kind(v: Column, name: str) -> Column:
    """The field's JSON type, such as STRING or BIGINT; VOID if it is absent or null."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("VOID"))


def is_number(v: Column, name: str) -> Column:
    return F.rlike(kind(v, name), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))


def price(v: Column, *names: str) -> Column:
    """The first field that is neither absent, empty nor 0, as a price: a number is truncated, a text's digits are read."""
    out = F.lit(0).cast("bigint")
    for name in reversed(names):
        number = F.try_variant_get(v, f"$.{name}", "double").try_cast("bigint")
        own = F.when(is_number(v, name), F.coalesce(number, F.lit(0))).when(kind(v, name) == "STRING", clean_price_text(text(v, name))).otherwise(F.lit(0).cast("bigint"))
        filled = F.when(is_number(v, name), F.try_variant_get(v, f"$.{name}", "double") != 0).otherwise(or_empty(text(v, name)) != "")
        out = own if name == names[-1] else F.when(filled, own).otherwise(out)
    return out


def category(v: Column) -> Column:
    levels = F.try_variant_get(v, "$.category", "array<string>")
    return F.when(F.startswith(kind(v, "category"), F.lit("ARRAY")), F.array_join(levels, " > ")).otherwise(or_empty(text(v, "category")))


def normalized(records: DataFrame) -> DataFrame:
    """Records with the canonical fields and ``valid``; other columns of ``records`` stay."""
    v = F.col("v")
    platform = F.lower(first_filled(text(v, "platform"), text(v, "source")))
    raw_id, title = text(v, "id"), first_filled(text(v, "title"), text(v, "name"), text(v, "subject"))
    # A count that isn't a whole number makes the record invalid, as does an id that isn't text.
    sold = F.when(kind(v, "sold_count").isin("VOID") | or_empty(text(v, "sold_count")).isin("", "0"), text(v, "all_time_quantity_sold")).otherwise(text(v, "sold_count"))
    sold = F.coalesce(F.nullif(sold, F.lit("")), F.lit("0"))
    sold_number = sold.try_cast("double").try_cast("bigint")
    prefixed = F.when((platform != "") & ~F.startswith(raw_id, platform), F.concat(platform, F.lit("_"), raw_id)).otherwise(raw_id)
    valid = (F.coalesce((kind(v, "id") == "STRING") & (raw_id != ""), F.lit(False)) | ((platform == "") & is_number(v, "id") & (F.coalesce(raw_id, F.lit("0")) != "0"))) & (title != "") & sold_number.isNotNull()
    fields = {
        "id": prefixed, "title": title, "price": price(v, "price"), "original_price": price(v, "original_price", "list_price", "price"), "sold_count": sold_number,
        "platform": platform, "category": category(v), "brand": F.coalesce(F.nullif(text(v, "brand"), F.lit("")), F.lit("No Brand")),
        "link": first_filled(text(v, "link"), text(v, "url"), text(v, "product_url")), "image_url": first_filled(text(v, "image_url"), text(v, "image"), text(v, "thumbnail_url")),
        **{n: or_empty(text(v, n)) for n in ("title_clean", "title_segmented", "source_file")},
    }
    others = [c for c in records.columns if c != "v"]
    return records.select(*others, *(c.cast(PRODUCT[n].dataType).alias(n) for n, c in fields.items()), F.coalesce(valid, F.lit(False)).alias("valid"))


def merge(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products of ordered files (``src_ord``, ``pos``), the first of each id; and the rejected records."""
    every = normalized(records)
    products = keep_first(every.where("valid"), ["id"], "src_ord", "pos").select(*PRODUCT.names)
    return products, every.where("NOT valid").select("value", "src_ord", "pos")


def coerced(df: DataFrame) -> DataFrame:
    """Canonical columns coerced as the record's constructor does: missing original price, one-line title, lower-case platform."""
    title = F.translate(strip(or_empty(F.col("title"))), "\n\r", " ")
    original = F.when(F.col("original_price").isNull() | (F.col("original_price") <= 0), F.col("price")).otherwise(F.col("original_price"))
    return df.withColumns({"title": title, "original_price": original.cast("bigint"), "price": F.col("price").cast("bigint"), "platform": F.lower("platform"),
                           "sold_count": F.coalesce(F.col("sold_count").cast("bigint"), F.lit(0))})


def _product(**fields: Column) -> Column:
    """A struct in the canonical order; what isn't given is empty."""
    default = {"sold_count": F.lit(0), "brand": F.lit("No Brand")} | {n: F.lit("") for n in ("category", "image_url", "title_clean", "title_segmented", "source_file")}
    given = default | fields
    return F.struct(*(given[n].cast(PRODUCT[n].dataType).alias(n) for n in PRODUCT.names))


def parse_tiki(v: Column) -> Column:
    """The product struct of an API record, null without an id."""
    raw = text(v, "id")
    cost = F.coalesce(F.try_variant_get(v, "$.price", "double").try_cast("bigint"), F.lit(0))
    listed = F.coalesce(F.nullif(F.try_variant_get(v, "$.list_price", "double").try_cast("bigint"), F.lit(0)), cost)
    return F.when(~or_empty(raw).isin("", "0"), _product(
        id=product_id(F.lit("tiki"), raw), platform=F.lit("tiki"), title=or_empty(text(v, "name")), price=cost, original_price=listed,
        sold_count=F.coalesce(F.try_variant_get(v, "$.quantity_sold.value", "bigint"), F.lit(0)), link=F.concat(F.lit("https://tiki.vn/"), or_empty(text(v, "url_path"))),
        image_url=or_empty(text(v, "thumbnail_url")), category=or_empty(text(v, "primary_category_path")), brand=F.coalesce(F.nullif(text(v, "brand_name"), F.lit("")), F.lit("No Brand"))))


def parse_chotot(v: Column) -> Column:
    """The product struct of a classified ad, null without a subject; a missing id is spelled None."""
    raw, subject = F.coalesce(text(v, "list_id"), F.lit("None")), or_empty(text(v, "subject"))
    cost = F.coalesce(F.try_variant_get(v, "$.price", "double").try_cast("bigint"), F.lit(0))
    return F.when((raw != "") & (subject != ""), _product(
        id=product_id(F.lit("chotot"), raw), platform=F.lit("chotot"), title=F.translate(strip(subject), "\n\r", " "), price=cost, original_price=cost,
        link=F.concat(F.lit("https://www.chotot.com/"), raw, F.lit(".htm")), image_url=or_empty(text(v, "image")), category=or_empty(text(v, "category_name")),
        brand=F.coalesce(F.nullif(F.nullif(text(v, "company_ad"), F.lit("")), F.lit("false")), F.lit("No Brand"))))


def parse_shopee(link: Column, lines: Column) -> Column:
    """The product struct of a card's link and lines of text, null without a price."""
    clean = F.substring_index(or_empty(link), "?", 1)
    first = F.get(lines, F.lit(0))
    badge = F.rlike(first, F.lit("Yêu thích|Mall|Ad"))
    title = F.when(badge, F.get(lines, F.lit(1))).otherwise(first)
    prices = F.filter(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("₫"))), lambda x: strip(F.substring_index(F.translate(x, "₫.", ""), "-", 1))), lambda p: F.rlike(p, F.lit(r"\A[0-9]+\z")))
    cost = F.coalesce(F.try_element_at(prices, F.lit(-1)).try_cast("bigint"), F.lit(0))
    sold = F.try_element_at(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("Đã bán"))), lambda x: strip(F.replace(x, F.lit("Đã bán"), F.lit("")))), F.lit(-1))
    number = F.translate(F.regexp_replace(F.coalesce(sold, F.lit("0")), "[kK]", "000"), ".,", "")
    return F.when((cost > 0) & title.isNotNull(), _product(
        id=product_id(F.lit("shopee"), F.substring_index(clean, "-i.", -1)), platform=F.lit("shopee"), title=title, price=cost, original_price=cost,
        sold_count=F.coalesce(F.when(F.rlike(number, F.lit(r"\A[0-9]+\z")), number.try_cast("bigint")), F.lit(0)), link=clean))


class _Card(HTMLParser):
    """Text and attributes of the elements of a result card that are of use."""

    CLASSES = {"title": ("s-item__title", "s-card__title"), "price": ("s-item__price", "s-card__price"), "link": ("s-item__link", "s-card__link"), "image": ("s-item__image-img",)}
    ALONE = {"img", "br", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, str | None]] = []
        self.found: dict[str, str] = {}
        self.rank: dict[str, int] = {}
        self.all: list[str] = []
        self.first_image: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        classes = (given.get("class") or "").split()
        name = None
        for key, wanted in self.CLASSES.items():
            for rank, c in enumerate(wanted):
                if c in classes and (key != "link" or tag == "a") and rank < self.rank.get(key, 9):
                    name, self.rank[key] = key, rank
                    self.found[key] = {"link": given.get("href") or "", "image": given.get("src") or given.get("data-src") or ""}.get(key, "")
        if tag == "img" and self.first_image is None:
            self.first_image = given.get("src") or given.get("data-src") or ""
        if tag not in self.ALONE:
            self.open.append((tag, name if name in ("title", "price") else None))

    def handle_endtag(self, tag: str) -> None:
        while self.open and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.all.append(data.strip())
            for _, name in self.open:
                if name:
                    self.found[name] += data.strip()


SOLD = re.compile(r"([\d,.]+)\+?\s*sold", re.IGNORECASE)


CARD = T.StructType([*(T.StructField(n, T.StringType()) for n in ("title", "link", "price", "image")), T.StructField("sold", T.LongType())])


@F.pandas_udf(CARD)
def ebay_card(cards: pd.Series) -> pd.DataFrame:
    """The parts of a result card's HTML (an Arrow UDF, as Spark has no HTML parser)."""
    rows = []
    for card in cards:
        parsed = _Card()
        parsed.feed(card or "")
        sold = SOLD.search(" ".join(parsed.all))
        digits = re.sub("[.,]", "", sold[1]) if sold else ""
        rows.append((parsed.found.get("title"), parsed.found.get("link"), parsed.found.get("price"), parsed.found.get("image") or parsed.first_image or "", int(digits) if digits else 0))
    return pd.DataFrame(rows, columns=["title", "link", "price", "image", "sold"])


def parse_ebay(cards: DataFrame, html: str, keyword: Column) -> DataFrame:
    """``cards`` with ``product``: null for a card without title, link or id, and for the advertisement card."""
    seen = cards.withColumn("_card", ebay_card(F.col(html)))
    link = F.substring_index(F.col("_card.link"), "?", 1)
    raw, cost = ebay_id(link), ebay_price(F.col("_card.price")).try_cast("bigint")
    valid = F.col("_card.title").isNotNull() & ~F.contains(F.col("_card.title"), F.lit("Shop on eBay")) & (or_empty(raw) != "")
    made = _product(id=product_id(F.lit("ebay"), raw), platform=F.lit("ebay"), title=F.col("_card.title"), price=cost, original_price=cost, sold_count=F.col("_card.sold"),
                    link=link, image_url=F.col("_card.image"), category=keyword)
    return seen.withColumn("product", F.when(valid, made)).drop("_card")
