"""WARC archives: writing pages as records, and reading records back along their verified boundary chain.

Reading cuts the archives at every occurrence of the magic line, in splits of any size. Each cut is only a candidate:
its header names the length of its block and so the offset at which the next record must begin. Every task follows
these successor offsets inside its split and emits, for each candidate, where the chain from there leaves the split;
pointer jumping over those rows from the start of each file finds the one place where each split is entered. A second
pass follows the chain from that place: only candidates that it reaches are records; magic lines inside payloads are
not, and their pieces go back to the record around them.

Both passes read the archives in place: texts are never shuffled, but for pieces of a record that is torn over splits
by a magic line in its payload. Whatever Spark can read can hold archives, since only Spark's own text source and sink
touch them.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import lean, replaced, shared_dir, store

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
LEAST_SHARED = 100  # bytes of a payload from which equal ones are written once
#: A split's two offsets and its place take fewer bytes; splits are as many as the archives have blocks.
SPLIT_BYTES = 200
MOST_BROADCAST = 256 << 20
#: Characters that a URI in a header never holds as they are: controls and every kind of line separator.
UNSAFE = "\x00-\x1F\x7F-\x9F\u2028\u2029"
#: Says that the URI beside it was percent-encoded here, and is to be decoded by readers.
ESCAPED = "Quirefold-Escaped-URI"


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def with_types(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, record_type and refers_to; columns of those names are replaced.

    First ids are found among digests alone. Their join with the pages is left to Spark, which broadcasts the digests
    only if their files are small, and otherwise shuffles once and splits common digests (adaptive skew join).
    """
    rows = pages.withColumn("payload", F.coalesce("html", F.lit(""))).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    shared = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("_wa_first"), F.count("*").alias("_wa_n")).filter("_wa_n > 1").drop("_wa_n")
    shared = store(shared, "warc-shared")
    first = F.col("_wa_first")
    again = F.coalesce(first < F.col("page_id"), first.isNotNull() & F.col("page_id").isNull())
    return rows.join(shared, "payload_digest", "left").withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, first)).drop("_wa_first")


def needs_escape(url: Column) -> Column:
    """Whether a header can't hold a url as it is: it has unsafe characters, or blanks at an end, which headers lose."""
    return url.rlike(f"[{UNSAFE}]|^[ \t]|[ \t]$")


def escaped(url: Column) -> Column:
    """url with its unsafe characters, blanks, `%` and `+` percent-encoded; `url_decode` gives it back."""
    code = lambda c: F.when(c == " ", "%20").when(c.rlike(f"[{UNSAFE}%+]"), F.url_encode(c)).otherwise(c)
    return F.array_join(F.transform(F.split(url, ""), code), "")


def record(date: str) -> Column:
    """A record without its magic line's successor: header, block; END follows it in the file."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(F.col("record_type") == "response", F.concat(http, F.col("payload"))).otherwise(http)
    revisit = F.concat(_line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        F.when(F.col("url").isNull(), F.lit("")).when(needs_escape(F.col("url")), F.concat(_line(ESCAPED, "1"), _line("WARC-Target-URI", escaped(F.col("url"))))).otherwise(_line("WARC-Target-URI", F.col("url"))),
        _line("WARC-Date", date),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(F.col("record_type") == "revisit", revisit).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, block)


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least: int = LEAST_SHARED) -> None:
    """One record for each row of pages (page_id, url, html) in the archives under path.

    A null html has an empty payload. Rows that share the smallest page_id of a payload are all responses; a null id
    refers to the smallest id there is.
    """
    with_types(pages, least).select(record(date).alias("value")).write.option("lineSep", END).text(path)


def archives(spark, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path)


def _field(head: Column, name: str) -> Column:
    """A header field. Lines end at LF alone (`d`), a CR before it is not part of the value: no other separator makes a line."""
    return F.regexp_extract(head, rf"(?imd)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)


def parsed(text: Column) -> dict[str, Column]:
    """What a piece says of itself; its payload is a record's own only if the piece is a whole record."""
    head = F.substring_index(text, END, 1)
    block = F.substring(text, F.length(head) + len(END) + 1, F.length(text))
    http = F.substring_index(block, END, 1)
    length = F.when(F.instr(text, END) > 0, _field(head, "Content-Length").try_cast("long"))
    length = F.when(length >= 0, length)
    skip = F.octet_length(head) + 2 * len(END) + F.octet_length(http)
    size = length - F.octet_length(http) - len(END)
    payload = F.substring(text.cast("binary"), skip + 1, F.greatest(size, F.lit(0)).cast("int"))
    return {
        "page_id": F.regexp_extract(_field(head, "WARC-Record-ID"), r"^<urn:page:(-?\d+)>$", 1).try_cast("long"),
        "record_type": _field(head, "WARC-Type"),
        "refers_to": F.regexp_extract(_field(head, "WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1).try_cast("long"),
        "url": F.when(_field(head, ESCAPED) == "1", F.url_decode(_field(head, "WARC-Target-URI"))).when(head.rlike(r"(?imd)^WARC-Target-URI:"), _field(head, "WARC-Target-URI")),
        "declared": F.regexp_extract(_field(head, "WARC-Payload-Digest"), r"^sha256:([0-9a-f]{64})$", 1),
        "declared_bytes": _field(http, "Content-Length").try_cast("long"),
        "whole": F.octet_length(head) + len(END) + length + len(END),
        "payload": payload,
    }


def _by_split(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[bool, tuple]]:
    """(whether a split begins, row) of rows that come in the order of their splits."""
    last = None
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in names]):
            yield (row[0], row[1]) != last, row
            last = row[0], row[1]


def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, held, at, to, last) of the candidates of each split; offsets count from the split's first piece.

    `to` is where the chain from a candidate arrives outside the split, `last` the last record before that. One row
    more a split, without `at`, says how many bytes its pieces hold.
    """
    m = len(MAGIC)
    names = ["file", "block", "size", "whole"]

    def settle(file: str, block: int, held: int, jump: dict[int, int]) -> pa.RecordBatch:
        out: dict[int, tuple[int, int]] = {}
        for at in sorted(jump, reverse=True):  # successors lie behind, so they are settled first
            out[at] = out.get(jump[at], (jump[at], at))
        n = len(out) + 1
        columns = [[file] * n, [block] * n, [held] * n, [None, *out], [None, *[x for x, _ in out.values()]], [None, *[y for _, y in out.values()]]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 5))], ["file", "block", "held", "at", "to", "last"])

    file, block, held, jump = None, 0, 0, {}
    for new, (f, b, size, whole) in _by_split(batches, names):
        if new and file is not None:
            yield settle(file, block, held, jump)
        if new:
            file, block, held, jump = f, b, 0, {}
        if whole is not None:
            jump[held] = held + m + whole
        held += size + m
    if file is not None:
        yield settle(file, block, held, jump)


def entries(found: DataFrame) -> DataFrame:
    """(file, block, base, entry, owner) of each split: its place in the file, where a record first begins in it, and
    the record that reaches into it from before. found: the rows of `exits`."""
    return _entries(found)[0]


def _entries(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The splits' entries, and (file, ends, length) of each file: where its chain ends, and how long it is."""
    m = len(MAGIC)
    sizes = found.filter("at is null").select("file", "block", "held")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Text before the first magic line comes as a piece like others, though no magic line stands before it.
    splits = store(sizes.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0)) - m).drop("held"), "warc-splits")
    most = splits.groupBy("file").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    placed = found.filter("at is not null").join(splits, ["file", "block"])
    base = F.col("base")
    jumps = store(placed.select("file", "block", (base + F.col("at")).alias("at"), (base + F.col("to")).alias("to"), (base + F.col("last")).alias("last")).filter("at >= 0"), "warc-jumps")
    reached, far = jumps.filter("at = 0").select("file", "at"), jumps.select("file", "at", "to")
    reach = 1
    while reach < most:  # each round doubles the number of splits that the chain has passed
        step = reached.join(far, ["file", "at"]).select("file", F.col("to").alias("at")).join(jumps.select("file", "at"), ["file", "at"], "left_semi")
        reached = replaced(reached.unionByName(step).distinct(), "warc-reached", reached)
        ahead = far.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        far = replaced(far.join(ahead, ["file", "to"]).select("file", "at", F.col("then").alias("to")), "warc-far", far)
        reach *= 2
    passed = reached.join(jumps, ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"), F.max("last").alias("last"))
    owner = F.last("last", ignorenulls=True).over(before)
    lengths = sizes.groupBy("file").agg((F.sum("held") - m).alias("length"))
    ended = reached.join(jumps, ["file", "at"]).groupBy("file").agg(F.max("to").alias("ends"))
    ends = store(lengths.join(ended, "file", "left").select("file", F.coalesce("ends", F.lit(0)).alias("ends"), "length"), "warc-ends")
    return store(splits.join(passed, ["file", "block"], "left").withColumn("owner", owner).drop("last"), "warc-entries"), ends


PART = "file string, at long, owner long, whole boolean, text binary"


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, at, owner, whole, text): records that are whole inside a split, and the pieces of those that are not."""
    m, magic = len(MAGIC), MAGIC.encode()
    rows: list[tuple] = []
    held = 0
    now: list | None = None  # file, offset, length, pieces of the record that is being put together
    at = due = 0

    def give(file: str, at: int, owner: int, whole: bool, text: bytes) -> None:
        nonlocal held
        rows.append((file, at, owner, whole, text))
        held += len(text)

    def done() -> None:
        nonlocal now
        if now:
            text = magic.join(now[3])
            give(now[0], now[1], now[1], len(text) >= now[2], text)
            now = None

    def batch() -> pa.RecordBatch:
        nonlocal held
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["file", "at", "owner", "whole", "text"])
        rows.clear()
        held = 0
        return out

    for new, (file, _, base, entry, owner, length, text) in _by_split(batches, ["file", "block", "base", "entry", "owner", "length", "text"]):
        if new:
            done()
            at, due = base, entry
        if at == due and length is not None:
            done()
            now, due = [file, at, length, [text]], at + m + length
        elif now:
            now[3].append(text)
        elif owner is not None and at >= 0:
            give(file, at, owner, False, text)
        at += len(text) + m
        if held > 8 << 20 or len(rows) > 2000:
            yield batch()
    done()
    if rows:
        yield batch()


class BrokenChain(ValueError):
    """An archive whose chain of records doesn't end where its file does."""


def texts(spark, path: str, strict: bool = False) -> DataFrame:
    """(text) of every record of the archives, what follows its magic line.

    Records behind a broken link of a file's chain, or cut off by its end, are left out, with a warning that names the
    number of such files and one of them; strict: they are an error.
    """
    cut = archives(spark, path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    whole = parsed(F.col("value"))["whole"]
    found = store(cut.select("file", "block", F.octet_length("value").cast("long").alias("size"), whole.alias("whole")).mapInArrow(lean(exits), "file string, block long, held long, at long, to long, last long"), "warc-exits")
    splits, ends = _entries(found)
    broken = ends.filter("ends <> length")
    if first := broken.head(1):
        what = f"{broken.count()} archives have a chain of records that doesn't end where the file does; one is {first[0]['file']}: {first[0]['ends']} of {first[0]['length']} bytes"
        if strict:
            raise BrokenChain(what)
        warnings.warn(what, stacklevel=2)
    placed = cut.withColumn("length", whole)
    if splits.count() * SPLIT_BYTES <= MOST_BROADCAST:  # a short row for each split, which keeps the rows' order
        placed = placed.join(F.broadcast(splits), ["file", "block"])
    else:
        placed = placed.withColumn("row", F.monotonically_increasing_id()).join(splits, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "row")
    parts = placed.select("file", "block", "base", "entry", "owner", "length", F.col("value").cast("binary").alias("text")).mapInArrow(lean(chained), PART)
    out = parts.filter("whole").select("text")
    torn = parts.filter("not whole")
    if torn.head(1):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("text").cast("string").alias("text")))), lambda p: p["text"]), MAGIC)
        out = out.unionByName(torn.groupBy("file", "owner").agg(joined.cast("binary").alias("text"), F.min("at").alias("at")).filter("at = owner").select("text"))
    text = F.col("text").cast("string")
    return out.select(text.alias("text")).filter(F.octet_length("text") >= parsed(F.col("text"))["whole"])


def read(spark, path: str, strict: bool = False) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, declared, declared_bytes) of every record of the archives.

    An archive without a magic line, or an empty folder of archives, has no records; from a broken link of the chain to
    the end of its file none are returned, whatever follows; `texts` warns of such files or, if strict, raises.
    Urls come back as they were written, with any characters; a record without one has a null url.
    """
    said = parsed(F.col("text"))
    return texts(spark, path, strict).select(*[said[c].alias(c) for c in ("page_id", "url", "record_type", "refers_to", "payload", "declared", "declared_bytes")])


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives of pages.

    Sizes and digests of responses are worked out from the payloads read; revisits carry those of their header.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    back = read(spark, path, strict=True)
    response = F.col("record_type") == "response"
    size = F.when(response, F.octet_length("payload")).otherwise(F.col("declared_bytes")).cast("long")
    digest = F.when(response, F.sha2("payload", 256)).otherwise(F.col("declared"))
    return back.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
