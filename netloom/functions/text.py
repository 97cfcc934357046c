"""Scalar rules over urls, headers, bodies and formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content types and file extensions of the categories of resources, in the order they are tried.
MIME_RULES = (("js", "javascript|ecmascript"), ("css", "css"), ("html", "html"), ("image", "image/"), ("video", "video/"), ("flash", "flash"), ("font", "font"))
EXTENSIONS = {"js": ("js", "mjs"), "css": ("css",), "html": ("html", "htm"), "image": ("png", "jpg", "jpeg", "gif", "webp", "svg", "avif", "ico"), "video": ("mp4", "webm"), "flash": ("swf",), "font": ("woff", "woff2", "ttf", "otf", "eot")}
#: How a browser names request priorities.
PRIORITIES = {"VeryHigh": "Highest", "HIGHEST": "Highest", "MEDIUM": "High", "LOW": "Medium", "LOWEST": "Low", "IDLE": "Lowest", "VeryLow": "Lowest"}


def js_round(x: Column) -> Column:
    """Halves are rounded up."""
    return F.floor(x + 0.5)


def leading_int(s: Column) -> Column:
    """The number that a text begins with, or null."""
    return F.regexp_extract(s, r"^\s*([+-]?\d{1,18})", 1).try_cast("bigint")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def url_path(url: Column) -> Column:
    """Path and query, without the fragment."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def url_port(url: Column) -> Column:
    port = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*:(\d{1,5})(?:[/?#]|$)", 1)
    return F.when(port != "", port.cast("int")).when(F.lower(url).startswith("https:"), 443).otherwise(80)


def is_web(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike("^https?://"), F.lit(False))


def is_noise(url: Column) -> Column:
    """Requests of the test harness and of the browser itself."""
    return F.coalesce(url.rlike(r"^(http://127\.0\.0\.1:8888|chrome://tracing|chrome-extension://)"), F.lit(False))


def url_label(url: Column, most: int) -> Column:
    """host - path, with an ellipsis in the middle of what is longer than ``most``."""
    full = F.concat(url_host(url), F.lit(" - "), url_path(url))
    half = (most - 3) // 2
    return F.when(F.length(full) <= most, full).otherwise(F.concat(F.substring(full, 1, most - 3 - half), F.lit("..."), F.right(full, F.lit(half))))


def mime_category(mime: Column, url: Column) -> Column:
    """The category of a resource by its content type, else by its extension, else other."""
    out, ext = None, F.lower(F.regexp_extract(url, r"\.([a-zA-Z0-9]+)(?:[?#]|$)", 1))
    for name, rule in MIME_RULES:
        hit = F.lower(F.coalesce(mime, F.lit(""))).rlike(rule)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    for name, ends in EXTENSIONS.items():
        out = out.when(ext.isin(*ends), name)
    return out.otherwise("other")


#: Names of tags at a page's beginning; of rules and properties of style sheets; words of scripts; ISOBMFF brands.
PAGE_TAGS = ("html", "head", "body")
AT_RULES = ("charset", "import", "media", "font-face", "keyframes", "layer", "supports", "namespace")
PROPERTIES = ("display", "margin", "padding", "color", "background", "border", "width", "height", "position", "overflow", "align", "flex", "grid")
STATEMENTS, GLOBALS, FUNCTION = ("var", "let", "const", "import", "export"), ("window", "document", "self", "globalthis"), "function"
AVIF_BRANDS, HEIC_BRANDS = ("avif", "avis"), ("heic", "heix", "hevc", "hevx", "mif1")


def _begins(text: Column, heads: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, heads)), lambda h: F.startswith(text, h))


def _style_rule(text: Column) -> Column:
    """Whether a selector, a block with a declaration and a known property stand in a lower-case text."""
    selector, rest = F.substring_index(text, "{", 1), F.substr(text, F.instr(text, "{") + 1)
    block = F.substring_index(rest, "}", 1)
    names = F.regexp_extract_all(text, F.lit(r"([a-z-]+)\s*:"), F.lit(1))
    known = F.exists(names, lambda n: F.substring_index(n, "-", -1).isin(*PROPERTIES))
    opens = F.contains(text, F.lit("{")) & F.substring(selector, 1, 1).rlike("[a-z_]|[^\\w\\s<(\"'/@&;!]")
    return opens & (F.contains(block, F.lit(":")) | F.contains(block, F.lit(";"))) & known


def _script(text: Column, sample: Column) -> Column:
    """Whether a lower-case text begins with a statement, an access to a global, or a function that is called at once; after a comment any script word tells."""
    word = F.regexp_extract(text, "^[a-z]+", 0)
    after, dense = F.substr(text, F.length(word) + 1, F.lit(1)), F.regexp_replace(F.substring(text, 1, 64), r"\s", "")
    called = _begins(dense, (f"({FUNCTION}", f"!{FUNCTION}", f"void{FUNCTION}", "(()"))
    strict = F.substring(text, 2, 10) == "use strict"
    words = F.regexp_extract_all(sample, F.lit("([a-z]+)[ (;]"), F.lit(1))
    shown = F.arrays_overlap(words, F.array(*map(F.lit, (*STATEMENTS, FUNCTION, "return")))) | F.contains(sample, F.lit("=>"))
    return (
        (word.isin(*STATEMENTS) & (after == " ")) | ((word == FUNCTION) & after.isin(" ", "(")) | (word.isin(*GLOBALS) & (after == "."))
        | strict | called | (_begins(text, ("//", "/*")) & shown)
    )


def sniff_text(body: Column) -> Column:
    """The kind of a text body by its first 1024 characters: markup, then style sheets, then scripts; empty where it shows none.

    The text is told by its first word and what stands before and after it.
    """
    sample = F.lower(F.substring(body, 1, 1024))
    text = F.regexp_replace(sample, "^[\\s\\uFEFF\\xEF\\xBB\\xBF]+", "")
    mark, word = F.regexp_extract(text, r"^\W*", 0), F.regexp_extract(text, r"^\W*([a-z-]*)", 1)
    tags = F.regexp_extract_all(text, F.lit("<(!?[a-z]+)"), F.lit(1))
    commented = F.startswith(text, F.lit("<!--")) & F.exists(tags, lambda t: _begins(t, ("html", "head", "!doctype")))
    page = ((mark == "<") & _begins(word, PAGE_TAGS)) | ((mark == "<!") & F.startswith(word, F.lit("doctype"))) | commented
    style = ((mark == "@") & _begins(word, AT_RULES)) | _style_rule(text)
    return F.when(page, "text/html").when(style, "text/css").when(_script(text, sample), "application/javascript").otherwise("")


def sniff_magic(body: Column) -> Column:
    """The kind of a binary body by its first bytes, or null."""
    h = F.hex(F.substring(body, 1, 12))
    boxed = lambda brands: F.substring(h, 9, 16).isin(*[f"ftyp{b}".encode().hex().upper() for b in brands])
    return (
        F.when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("89504E47"), "image/png").when(h.startswith("47494638"), "image/gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp").when(boxed(AVIF_BRANDS), "image/avif").when(boxed(HEIC_BRANDS), "image/heic")
        .when(h.startswith("774F4646"), "font/woff").when(h.startswith("774F4632"), "font/woff2").when(h.startswith("00010000"), "font/ttf").when(h.startswith("4F54544F"), "font/otf")
    )


def sniff_body(body: Column) -> Column:
    """The kind of a body of bytes: by its first bytes, else as text; empty where neither tells."""
    return F.coalesce(sniff_magic(body), sniff_text(F.decode(F.substring(body, 1, 1024), "ISO-8859-1")), F.lit(""))


def sniff_format(head: Column) -> Column:
    """The capture format that the text of a file's beginning shows; the first rule that fits wins."""
    t = F.regexp_replace(head, r"\s", "")
    has = lambda *keys: F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(t, k))
    begins = lambda *keys: F.exists(F.array(*map(F.lit, keys)), lambda k: F.startswith(t, k))
    return (
        F.when(F.contains(head, F.lit("org.chromium.trace_metadata")) | F.contains(head, F.lit("Perfetto v")) | F.contains(head, F.lit("TracePacket")), "perfetto")
        .when(has('{"constants":') & has('"logEventTypes":'), "netlog")
        .when(has("CLIENT_RANDOM", "CLIENT_HANDSHAKE_TRAFFIC_SECRET", "CLIENT_TRAFFIC_SECRET_0"), "keylog")
        .when(has('"data":{') & has('"median":', '"runs":', '"testRuns":', '"average":'), "wpt")
        .when(has('"traceEvents":[') | (has('{"pid":') & has('"ts":') & has('"cat":')), "chrome-trace")
        .when(begins('[{"pid":', '[{"cat":', '[{"name":', '[{"args":'), "chrome-trace")
        .when(begins('[{"method":"') | has('{"method":"Network.'), "cdp")
        .when(has('{"log":{"version":', '{"log":{"creator":', '{"log":{"pages":'), "har")
        .otherwise("unknown")
    )


#: Names within page-test archives, of which one in the first 64 KB tells them.
ARCHIVE_NAMES = ("testinfo.json", "testinfo.ini", "video_1/ms_", "video_1_cached/ms_", "_devtools_requests.json", "_netlog_requests.json", "_page_data.json", "_visual_progress.json", "_timed_events.json", "_script_timing.json", "_trace.json.gz", "_timeline_cpu.json", "_long_tasks.json", "_interactive.json", "lighthouse.json.gz", "_bodies.zip")


def _byte(content: Column, at: Column) -> Column:
    """The byte at a place from 0 on, or null."""
    return F.conv(F.hex(F.substr(content, at + 1, F.lit(1))), 16, 10).try_cast("int")


def is_packet_stream(content: Column) -> Column:
    """Whether a length-delimited field 1 comes first and the same tag follows where it ends (a length has 4 bytes at most)."""
    size, end = F.lit(0), F.lit(None).cast("int")
    for i in range(1, 5):
        b = _byte(content, F.lit(i))
        size = F.when(end.isNull(), size + F.shiftleft(b.bitwiseAND(127), 7 * (i - 1))).otherwise(size)
        end = F.coalesce(end, F.when((b < 128) | F.lit(i == 4), i + 1))
    return F.coalesce((_byte(content, F.lit(0)) == 10) & (_byte(content, end + size) == 10), F.lit(False))


def sniff_capture(content: Column) -> Column:
    """The format of a capture by its first bytes (not gzipped), else by its text."""
    h = F.hex(F.substring(content, 1, 4))
    text = F.decode(F.substring(content, 1, 65536), "ISO-8859-1")
    return (
        F.when((h == "504B0304") & F.exists(F.array(*map(F.lit, ARCHIVE_NAMES)), lambda n: F.contains(text, n)), "wptagent")
        .when(h.isin("A1B2C3D4", "D4C3B2A1", "A1B23C4D", "4D3CB2A1", "0A0D0D0A"), "tcpdump")
        .when(is_packet_stream(content), "perfetto")
        .otherwise(sniff_format(text))
    )


def split_header(line: Column) -> Column:
    """name and value of a header line, cut at its first colon; null where the colon comes first or is missing."""
    at = F.instr(line, ":")
    return F.when(at > 1, F.struct(F.trim(F.substr(line, F.lit(1), at - 1)).alias("name"), F.trim(F.substr(line, at + 1)).alias("value")))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, whatever its case; headers may repeat and keep their order."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), 0)["value"]


def status_of(line: Column) -> Column:
    return F.regexp_extract(line, r"^(?:HTTP/[\d.]+|:status:)\s*(\d{3})", 1).try_cast("int")


def priority_name(priority: Column, names: dict[str, str] | None = None) -> Column:
    out = None
    for k, v in (names or PRIORITIES).items():
        out = F.when(priority == k, v) if out is None else out.when(priority == k, v)
    return out.otherwise(priority)


def http_date_ms(value: Column) -> Column:
    """Epoch ms of an HTTP date, or null; the weekday is not read."""
    return F.unix_millis(F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss zzz")))


def flag_names(bits: Column, names: dict[int, str]) -> Column:
    """Names of the bits that are set, in the order given."""
    hits = F.array(*[F.when(bits.bitwiseAND(b) != 0, F.lit(n)) for b, n in names.items()])
    return F.array_join(F.array_compact(hits), ",")


def rating(value: Column, good: float, poor: float) -> Column:
    return F.when(value <= good, "good").when(value <= poor, "warning").otherwise("poor")


def humanize_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))


def bare_mime(content_type: Column) -> Column:
    """The type of a content type, without its parameters."""
    return F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))


def lookup_host(key: Column) -> Column:
    """The host of a lookup's key, without scheme and port; a mark that comes first cuts nothing."""
    return F.regexp_replace(F.regexp_replace(key, "^.+?://", ""), "^([^:]+):.*$", "$1")


def base64url(text: Column) -> Column:
    """The bytes of a base64url text; padding may be missing."""
    return F.unbase64(F.translate(text, "-_", "+/"))


def merge_base64(parts: Column) -> Column:
    """One base64 text of the bytes of several, each of which was encoded for itself."""
    return F.base64(F.aggregate(parts, F.lit("").cast("binary"), lambda a, x: F.concat(a, F.unbase64(x))))


def view_title(run: Column, cached: Column, url: Column) -> Column:
    """The title of a view of a page test."""
    which = F.when(cached.cast("int") != 0, "Repeat View").otherwise("First View")
    return F.concat(F.lit("Run "), run.cast("string"), F.lit(", "), which, F.lit(" for "), F.coalesce(url, F.lit("")))


def view_id(run: Column, cached: Column) -> Column:
    return F.concat(F.lit("page_"), run.cast("string"), F.lit("_"), cached.cast("int").cast("string"), F.lit("_1"))


def export_url(url: Column) -> Column:
    """Where the results of a page test are exported, from the url of its result page; other urls as they are."""
    test = F.coalesce(F.nullif(F.regexp_extract(url, r"/result/(\d{6}_[^/]+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"/results\.php\?.*test=(\d{6}_[^&]+)", 1), F.lit("")))
    origin = F.regexp_extract(url, "^(https?://[^/]+)", 1)
    return F.when(test.isNotNull() & (origin != ""), F.concat(origin, F.lit("/export.php?bodies=1&test="), test)).otherwise(url)


def keylog_path(path: Column) -> Column:
    """Where the key log of a packet capture is looked for."""
    out = F.regexp_replace(path, r"^(.*?)\.cap\.gz", "$1.key_log.txt.gz")
    return F.regexp_replace(F.regexp_replace(out, r"^(.*?)\.pcapng", "$1.key_log.txt"), r"^(.*?)\.pcap", "$1.key_log.txt")


#: The least HTTP/2 weight, and the greatest urgency (RFC 9218), of each priority.
WEIGHTS = ((256, "Highest"), (220, "High"), (183, "Medium"), (147, "Low"))
URGENCIES = ((1, "Highest"), (2, "High"), (3, "Medium"), (5, "Low"))


def weight_priority(weight: Column) -> Column:
    out = F.when(weight.isNull(), F.lit(None).cast("string"))
    for least, name in WEIGHTS:
        out = out.when(weight >= least, name)
    return out.otherwise("Lowest")


def urgency_priority(header: Column) -> Column:
    """The priority that u=N of a priority header names; null without it."""
    urgency = F.regexp_extract(header, r"u=(\d)", 1).try_cast("int")
    out = F.when(urgency.isNull(), F.lit(None).cast("string"))
    for most, name in URGENCIES:
        out = out.when(urgency <= most, name)
    return out.otherwise("Lowest")


def request_url(url: Column, line: Column, group: Column, secure: Column, headers: Column) -> Column:
    """url, or one made of what was sent: the path of the request line, and scheme, host and path among ``headers`` (lines), the last of each.

    The scheme is https where the socket group says ssl, or, without a group, where the socket is ``secure``.
    """
    fields = F.filter(F.transform(headers, split_header), lambda h: h.isNotNull())
    told = lambda *names: F.element_at(F.filter(fields, lambda h: F.lower(F.ltrim(h["name"])).isin(*names)), -1)["value"]
    last = lambda *names: F.when(F.exists(fields, lambda h: F.lower(F.ltrim(h["name"])).isin(*names)), told(*names))
    by_group = F.when(group.isNotNull(), F.when(F.contains(group, F.lit("ssl/")), "https").otherwise("http"))
    scheme = F.coalesce(last("scheme"), by_group, F.when(secure.isNotNull(), F.when(secure, "https").otherwise("http")))
    path = F.coalesce(last("path"), F.nullif(F.regexp_extract(line, r"^\S+\s(\S+)", 1), F.lit("")))
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(scheme, F.lit("://"), last("host", "authority"), path))


def nudged(start: Column, number: Column) -> Column:
    """A start moved by a part of the request's number, so that equal starts keep the order of the numbers."""
    return start + (number % 10000) / 1_000_000.0
