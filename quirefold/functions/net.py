"""Addresses and errors as columns: URL guard, retryable errors, ignore labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that recognition leaves out unless an option includes them; fixed order.
IGNORABLE = ("header", "footer", "page_number", "aside_text", "header_image", "footer_image", "footnote")
RETRYABLE_CODES = (500, 10010)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def has_userinfo(url: Column) -> Column:
    return url.rlike(r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*@")


def _octet(host: Column, i: int) -> Column:
    return F.try_element_at(F.split(host, r"\."), F.lit(i)).try_cast("int")


def is_internal_v4(host: Column) -> Column:
    """Addresses that only a deployment's own network reaches, and reserved ones."""
    a, b, c = (_octet(host, i) for i in (1, 2, 3))
    documentation = ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    return a.isin(0, 127) | private | documentation | (a >= 224)


def is_internal_v6(host: Column) -> Column:
    """Loopback, unspecified, unique local, link local, multicast and documentation addresses in brackets."""
    inner = F.lower(F.translate(host, "[]", ""))
    mapped = F.regexp_extract(inner, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    return inner.isin("::1", "::") | inner.rlike(r"^f[cd][0-9a-f]{2}:|^fe[89ab][0-9a-f]:|^ff[0-9a-f]{2}:|^2001:0?db8:") | ((mapped != "") & is_internal_v4(mapped))


def is_internal_name(host: Column) -> Column:
    name = F.regexp_replace(host, r"\.+$", "")
    return (F.instr(name, ".") == 0) | name.rlike(r"\.(localhost|local|internal|home\.arpa)$")


def is_internal(host: Column) -> Column:
    return F.when(host.startswith("["), is_internal_v6(host)).when(host.rlike(r"^\d+\.\d+\.\d+\.\d+$"), is_internal_v4(host)).otherwise(is_internal_name(host))


def url_verdict(url: Column, network_mode: bool = True, allowed: tuple[str, ...] = ()) -> Column:
    scheme, host = url_scheme(url), url_host(url)
    out = F.when(host == "", "invalid").when(~scheme.isin("http", "https"), "scheme").when(has_userinfo(url), "userinfo")
    if allowed:
        port = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
        full = F.concat(host, F.lit(":"), F.when(port != "", port).when(scheme == "https", "443").otherwise("80"))
        out = out.when(host.isin(*allowed) | full.isin(*allowed), "ok")
    return out.when(F.lit(network_mode) & (scheme != "https"), "https").when(F.lit(network_mode) & is_internal(host), "internal").otherwise("ok")


def is_retryable(kind: Column, status: Column, code: Column) -> Column:
    return F.coalesce((kind == "network") | (status == 429) | status.between(500, 599) | code.isin(*RETRYABLE_CODES), F.lit(False))


def ignore_labels(flags: dict[str, Column]) -> Column:
    """The labels that are left out, in their fixed order. flags: label to whether it is included."""
    return F.filter(F.array(*[F.when(~flags[name], F.lit(name)) for name in IGNORABLE]), lambda x: x.isNotNull())


#: Options that are handed on as they are, by the service's name for them; fixed values.
PASSED_ON = (
    "useDocOrientationClassify", "useDocUnwarping", "useLayoutDetection", "useChartRecognition", "useSealRecognition", "useOcrForImageBlock", "mergeTables", "relevelTitles", "layoutShapeMode",
    "promptLabel", "repetitionPenalty", "temperature", "topP", "minPixels", "maxPixels", "layoutNms", "restructurePages",
)


def document_payload(flags: dict[str, Column], options: dict[str, Column]) -> Column:
    """The JSON of a document request: labels to leave out, and every option, null where it isn't given."""
    fields = [options.get(name, F.lit(None).cast("string")).alias(name) for name in PASSED_ON]
    return F.to_json(F.struct(ignore_labels(flags).alias("markdownIgnoreLabels"), *fields), {"ignoreNullFields": "false"})


def parsed_error(payload: Column) -> Column:
    """(kind, message, retryable, provider) of an error that a service hands on as JSON or as plain text.

    A tagged object says its kind. Of `Ocr` the data are an object with a message, whether a new attempt may help, and the
    provider; of other kinds the data are the message, and only `Network` may be tried again. A JSON string, and a text
    that isn't JSON, is an internal error's message; any other value is one's text as it stands.
    """
    v = F.try_parse_json(payload)
    at = lambda path: F.try_variant_get(v, path, "variant")
    kind_of = lambda x: F.schema_of_variant(x)
    text = lambda x: F.when(kind_of(x) == "STRING", F.try_variant_get(x, "$", "string"))
    kind, data = at("$.kind"), at("$.data")
    flag = at("$.data.retryable")
    truthy = F.coalesce(F.when(kind_of(flag) == "BOOLEAN", F.try_variant_get(flag, "$", "boolean")).when(kind_of(flag) == "STRING", F.try_variant_get(flag, "$", "string") != "").when(kind_of(flag).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(flag, "$", "double") != 0).otherwise(flag.isNotNull() & ~F.is_variant_null(flag)), F.lit(False))
    inside = F.try_variant_get(data, "$", "map<string,variant>")
    error = lambda kind, message, retryable, provider=F.lit(None).cast("string"): F.struct(kind.alias("kind"), message.alias("message"), retryable.alias("retryable"), provider.alias("provider"))
    internal = lambda message: error(F.lit("Internal"), message, F.lit(False))
    return (
        F.when((text(kind) == "Ocr") & inside.isNotNull(), error(F.lit("Ocr"), text(at("$.data.message")), truthy, text(at("$.data.provider"))))
        .when(text(kind).isNotNull() & text(data).isNotNull(), error(text(kind), text(data), text(kind) == "Network"))
        .when(text(v).isNotNull(), internal(text(v)))
        .otherwise(internal(payload))
    )
