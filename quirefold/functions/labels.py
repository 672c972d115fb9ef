"""Columns of keys, messages, progress and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions import text as X

#: Providers that answer chats; fixed values.
CHAT = ("openai", "openrouter", "openai_compatible")
ROWS, WIDTH = (2, 18), 42


def target_key(page: Column, article: Column) -> Column:
    """page:n, or article:id where there is an article."""
    return F.when(article.isNotNull(), F.concat(F.lit("article:"), article.cast("string"))).otherwise(F.concat(F.lit("page:"), page.cast("string")))


def parsed_key(key: Column) -> Column:
    """(page, article) of a target key; null for any other text."""
    page = F.when(key.startswith("page:"), F.substring(key, 6, 1000).try_cast("double"))
    article = F.when(key.startswith("article:"), F.nullif(F.substring(key, 9, 100_000), F.lit("")))
    good = (page >= 1) & (page < float("inf"))
    return F.when(F.coalesce(good, F.lit(False)) | article.isNotNull(), F.struct(F.when(good, page).alias("page"), article.alias("article")))


#: Kinds of suggestions that are taken without a look; fixed values.
ACCEPTED = ("punct", "charform", "garble")


def default_verdict(category: Column) -> Column:
    return F.when(category.isin(*ACCEPTED), "accepted").otherwise("pending")


def is_chat_provider(provider: Column) -> Column:
    return provider.isin(*CHAT)


def proofread_provider(own: Column, general: Column) -> Column:
    return F.coalesce(own, general)


def proofread_model(own: Column, provider: Column, models: dict[str, Column]) -> Column:
    """An own model if one is set, else that of the provider; providers without chat have none."""
    general = F.lit("")
    for name in CHAT:
        general = F.when(provider == name, models[name]).otherwise(general)
    return F.coalesce(F.nullif(own, F.lit("")), general)


def proofread_prompt(own: Column, default: Column, with_images: Column, appendix: Column) -> Column:
    return F.concat(F.when(X.not_blank(own), own).otherwise(default), F.when(with_images, appendix).otherwise(F.lit("")))


def editor_rows(text: Column) -> Column:
    """Rows of an editor for a text: its lines, or those that its length takes, within limits."""
    lines = F.size(F.split(text, "\r\n|\r|\n", -1))
    return F.least(F.lit(ROWS[1]), F.greatest(F.lit(ROWS[0]), lines, F.ceil(F.length(text) / WIDTH))).cast("long")


def clamped_page(page: Column, total: Column) -> Column:
    return F.least(F.greatest(F.lit(1), F.floor(total)), F.greatest(F.lit(1), F.floor(page)))


def picked(zh: Column, en: Column, english: Column) -> Column:
    return F.when(english, en).otherwise(zh)


def first_points(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def interpolated(template: Column, params: Column) -> Column:
    """template with {name} replaced from a map; names without a value stay as they are."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))
    # The pieces between the braces are looked up one by one, so that a value with braces isn't read again.
    pieces = F.regexp_extract_all(template, F.lit(r"\{\w+\}|[^{]+|\{"), F.lit(0))
    value = lambda p: F.coalesce(F.try_element_at(params, F.regexp_extract(p, r"^\{(\w+)\}$", 1)), p)
    return F.when(F.size(names) == 0, template).otherwise(F.array_join(F.transform(pieces, value), ""))


def message(key: Column, own: Column, general: Column) -> Column:
    """A catalogue's wording, else the general one, else the key."""
    return F.coalesce(own, general, key)


def clean_progress(done: Column, total: Column, page: Column, requested: Column) -> Column:
    """(done, total, page) within the pages asked for; as given where none are known."""
    asked = F.struct(F.least(F.greatest(F.lit(0), done), requested).alias("done"), requested.alias("total"), F.least(F.greatest(F.lit(1), page), requested).alias("page"))
    return F.when(requested > 0, asked).otherwise(F.struct(done.alias("done"), total.alias("total"), page.alias("page")))


def headline(status: Column, stage: Column) -> Column:
    """The message key of a job: a status that isn't running beats any stage."""
    ended = F.when(status == "cancelling", "cancelling").when(status == "cancelled", "cancelled").when(status == "error", "error").when(status == "done", "finished")
    by_stage = F.when(stage.startswith("preparing_"), "preparing").when(stage.isin("page_done", "block_done"), "finished").when(stage == "proofread_running", "proofreading").otherwise("running")
    return F.concat(F.lit("progress."), F.coalesce(ended, by_stage))


def detail(stage: Column, a: Column, b: Column) -> Column:
    """The second line of a stage: the numbers a and b behind the message keys that tell what they count."""
    word = lambda name, n: F.concat(F.lit(name + " "), n.cast("string"))
    both = lambda x, y: F.concat(x, F.lit(" · "), y)
    out = F.when(stage == "preparing_blocks", word("blocks", a)).when(stage == "preparing_pages", word("pages", a)).when(stage == "preparing_articles", word("articles", a))
    out = out.when(stage == "preparing_chunks", both(F.lit("chunking"), word("pages", a))).when(stage == "submitting_document", both(F.lit("submitting"), word("pages", a)))
    out = out.when(stage == "chunk_submitting", both(word("chunk", a), word("pages", b))).when(stage == "chunk_running", word("chunk", a)).when(stage == "proofread_running", word("unit", a))
    return out.when(stage.isin("page_running", "page_done"), word("page", a)).when(stage.isin("block_running", "block_done"), word("article", a)).otherwise("")


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(done / total * 100 + 0.5))).otherwise(0).cast("long")
