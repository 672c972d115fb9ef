"""Validation of requests: one row a job with the first rule that it breaks, null where it breaks none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import labels as N
from quirefold.functions import text as X
from quirefold.functions.net import url_verdict

#: Limits of a proofreading request; fixed values.
UNITS, UNIT_CHARS, PROMPT_CHARS, BUDGET, MODEL_CHARS, IMAGES, IMAGE_BYTES, ALL_IMAGE_BYTES = 200, 20_000, 8_000, 400_000, 200, 20, 4 << 20, 40 << 20
#: Most pages of a whole-file request: of a PDF by document service, and of all others; fixed values.
DOCUMENT_PAGES, PAGES = 1000, 500
#: The provider whose endpoint the settings name; a fixed value.
OWN_ENDPOINT = "openai_compatible"


def first_fault(rules: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules])


def grouped_faults(requests: DataFrame, articles: DataFrame, blocks: DataFrame) -> DataFrame:
    """(job, fault) of requests (job, path, kind, dpi) for articles (job, article) with blocks (article, ...)."""
    counts = articles.join(blocks.groupBy("article").agg(F.count("*").alias("blocks")), "article", "left")
    held = counts.groupBy("job").agg(F.count("*").alias("articles"), F.count_if(F.col("blocks").isNull()).alias("bare"))
    rows = requests.join(held, "job", "left")
    rules = [("path", F.coalesce(F.col("path"), F.lit("")) == ""), ("articles", F.col("articles").isNull()), ("blocks", F.col("bare") > 0), ("dpi", (F.col("kind") == "pdf") & (F.coalesce("dpi", F.lit(0)) == 0))]
    return rows.select("job", first_fault(rules).alias("fault"))


def whole_file_faults(requests: DataFrame, pages: DataFrame, order: list[str], document_pages: int = DOCUMENT_PAGES, most: int = PAGES) -> DataFrame:
    """(job, fault) of requests (job, path, kind, provider) for pages (job, page) in the given order."""
    before = F.lag("page").over(Window.partitionBy("job").orderBy(*order))
    lists = pages.withColumn("_before", before).groupBy("job").agg(
        F.count("*").alias("n"), F.max(F.col("page") < 1).alias("zero"), F.max(F.col("page") != 1).alias("other"), (F.count("page") != F.countDistinct("page")).alias("repeated"), F.max(F.coalesce(F.col("_before") >= F.col("page"), F.lit(False))).alias("unordered")
    )
    limit = F.when((F.col("provider") == "paddleocr") & (F.col("kind") == "pdf"), document_pages).otherwise(most)
    rules = [("path", F.coalesce(F.col("path"), F.lit("")) == ""), ("pages", F.col("n").isNull()), ("zero", F.col("zero")), ("image", (F.col("kind") == "image") & F.col("other")), ("repeated", F.col("repeated")), ("order", F.col("unordered")), ("too_many", F.col("n") > limit)]
    return requests.join(lists, "job", "left").select("job", first_fault(rules).alias("fault"))


def image_fault(data: Column, size: Column, most: int = IMAGE_BYTES) -> Column:
    """What is wrong with a picture in base64 of so many bytes."""
    return first_fault([("empty", size == 0), ("large", size > most), ("prefix", data.startswith("data:")), ("base64", ~data.rlike("^[A-Za-z0-9+/=]*$"))])


def proofread_faults(requests: DataFrame, units: DataFrame, images: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(job, fault, budget) of requests (job, provider, model, prompt and, if there is one, base_url), units (job, key, text) and images (job, data).

    Rules about units come before those about pictures, and those before the settings'. limits replaces some of
    units, unit_chars, prompt_chars, budget, model_chars, images, image_bytes and all_image_bytes.
    """
    most = {"units": UNITS, "unit_chars": UNIT_CHARS, "prompt_chars": PROMPT_CHARS, "budget": BUDGET, "model_chars": MODEL_CHARS, "images": IMAGES, "image_bytes": IMAGE_BYTES, "all_image_bytes": ALL_IMAGE_BYTES} | (limits or {})
    chars = F.length("text")
    of_units = units.groupBy("job").agg(
        F.count("*").alias("units"), F.max(F.coalesce(F.col("key"), F.lit("")) == "").alias("keyless"), (F.count("key") != F.countDistinct("key")).alias("repeated"), F.max(~X.not_blank(F.col("text"))).alias("blank"), F.max(chars > most["unit_chars"]).alias("long"), F.sum(chars).alias("chars")
    )
    size = F.octet_length("data").cast("long")
    of_images = images.groupBy("job").agg(F.count("*").alias("images"), F.sum(size).alias("bytes"), F.min(image_fault(F.col("data"), size, most["image_bytes"])).alias("image"))
    rows = requests.join(of_units, "job", "left").join(of_images, "job", "left")
    budget = F.coalesce("chars", F.lit(0)) + F.coalesce("units", F.lit(0)) * F.length("prompt")
    model = F.coalesce(F.col("model"), F.lit(""))
    url = F.coalesce(F.col("base_url"), F.lit("")) if "base_url" in requests.columns else F.lit(None).cast("string")
    own = F.col("provider") == OWN_ENDPOINT  # only this provider has an endpoint to be set
    faults = [
        ("units", F.col("units").isNull()), ("too many units", F.col("units") > most["units"]), ("key", F.col("keyless")), ("repeated", F.col("repeated")), ("blank", F.col("blank")), ("long", F.col("long")),
        ("image", F.col("image").isNotNull()), ("too many images", F.col("images") > most["images"]), ("image bytes", F.col("bytes") > most["all_image_bytes"]),
        ("provider", ~N.is_chat_provider(F.col("provider"))), ("no model", model == ""), ("model", (F.length(model) > most["model_chars"]) | model.rlike(r"\p{Cc}")),
        ("no endpoint", own & (url == "")), ("endpoint", own & (url_verdict(url) != "ok")),
        ("prompt", F.length("prompt") > most["prompt_chars"]), ("budget", budget > most["budget"]),
    ]
    return rows.select("job", first_fault(faults).alias("fault"), budget.alias("budget"))
