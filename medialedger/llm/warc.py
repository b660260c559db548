"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Both new records refer to the response they come from (WARC-Refers-To), keep its target, date and payload digest, and carry
a digest of their own block. Record ids are UUIDs made from the response's id, so a rerun gives the same records. Everything
is column expressions but for joining what was read to whole records, and for pages whose markup is malformed or very long: regular
expressions could take time that grows with the square of such a page, so these are read by a scanner that passes once, in Arrow
batches. Nothing is shuffled.

Defined cases: references by name are those of HTML with their semicolon; without it they stay, as in OP5_SQL (HTML would
decode some); comments, scripts and styles without an end run to the end of the page; a null payload is empty; a response
without links or title has an empty list and an empty title; null targets stay null and their header line is left out; responses
without an id get one from their target and payload. Columns of responses that have the name of a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts
from .markup import Scanner, tokens

CRLF = "\r\n"
VERSION, LENGTH = b"WARC/1.0\r\n", re.compile(rb"(?im)^Content-Length:[ \t]*(\d+)")
#: References by name, with their semicolon. The most frequent come first.
FREQUENT = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "mdash;", "ndash;", "hellip;", "rsquo;", "lsquo;", "rdquo;", "ldquo;")
NAMES = dict.fromkeys(FREQUENT, "") | {n: c for n, c in html5.items() if n.endswith(";")}
NAMES |= {n: html5[n] for n in FREQUENT} | {"nbsp;": " "}
#: Numbers that stand for characters of Windows-1252.
C1 = {k: bytes([k]).decode("cp1252") for k in range(128, 160) if k not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
#: The rest of a start tag up to its end: quotes count after an equals sign, and what they hold may contain '>'.
REST = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>"""
HIDDEN = rf"(?is)<(?:!--.*?(?:-->|\z)|script\b{REST}.*?(?:</script\s*>|\z)|style\b{REST}.*?(?:</style\s*>|\z)|noscript\b{REST}.*?</noscript\s*>|template\b{REST}.*?</template\s*>|head\b{REST}.*?</head\s*>)"
#: White space that isn't a single blank already.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
BREAK_TAGS = "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
BREAKS = rf"(?i)</?(?:{'|'.join(BREAK_TAGS)})\b{REST}"
TAG = rf"<(?:/?[a-zA-Z]{REST}|[!?/][^>]*+>)"
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
#: The value of the first href of each link, with its quotes if it has any.
LINK = rf"(?i)<a(?=[\s/])(?:[\s/]*+(?!href\s*+=)[^\s/>][^\s/>=]*+(?:\s*+=\s*+{VALUE})?+)*+[\s/]*+href\s*+=\s*+({VALUE})"
TITLE = rf"(?is)<title\b{REST}(.*?)</title\s*>"
FIELDS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest", "content_type": "Content-Type"}


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A UUID from a hash of the parts."""
    h = F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that f uses more than once, made only once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _table(names: dict) -> Column:
    return F.str_to_map(F.lit("\x01".join(f"{n}\x02{c}" for n, c in names.items())), F.lit("\x01"), F.lit("\x02"))


def numbered(x: Column) -> Column:
    """What follows an ampersand, with a decimal or hexadecimal number decoded as HTML has it."""
    number = F.regexp_extract(x, "^#0*([0-9]+)", 1)
    hexa = F.regexp_extract(x, "^#[xX]0*([0-9a-fA-F]+)", 1)
    code = F.when(number != "", F.when(F.length(number) < 8, number.cast("int"))).otherwise(F.when(F.length(hexa) < 7, F.conv(hexa, 16, 10).cast("int")))
    fine = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
    char = F.when(code.between(128, 159), F.coalesce(F.try_element_at(_table(C1), code.cast("string")), char)).otherwise(char)
    rest = F.regexp_replace(x, "^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")
    return F.when((number != "") | (hexa != ""), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), x))


def decoded(text: Column) -> Column:
    """Character references, each once. A name without its semicolon stays as it is."""

    def after(x: Column, name: Column) -> Column:
        return F.substring(x, F.length(name) + 1, F.length(x))

    def one(x: Column, i: Column) -> Column:
        name = F.regexp_extract(x, "^[a-zA-Z][a-zA-Z0-9]*;", 0)
        named = F.concat(F.try_element_at(_table(NAMES), name), after(x, name))
        return F.when(i == 0, x).when(F.startswith(x, F.lit("amp;")), F.concat(F.lit("&"), after(x, F.lit("amp;")))).when(F.startswith(x, F.lit("#")), numbered(x)).otherwise(F.coalesce(named, F.concat(F.lit("&"), x)))

    return once(text, lambda t: F.when(F.instr(t, "&") == 0, t).otherwise(F.array_join(F.transform(F.split(t, "&", -1), one), "")))


def plain_text(page: Column) -> Column:
    """Visible text: a line for each block, with single blanks and without empty lines."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(page, HIDDEN, " "), SPACES, " "), BREAKS, "\n")
    text = decoded(F.regexp_replace(text, TAG, ""))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(?<! ) *+\n[ \n]*+", "\n"), " {2,}", " "), F.lit(" \n"))


def links(page: Column) -> Column:
    bare = F.transform(F.regexp_extract_all(page, F.lit(LINK), F.lit(1)), lambda v: F.regexp_replace(v, r"""(?s)^(["'])(.*)\1$""", "$2"))
    return F.transform(bare, decoded)


def title(page: Column) -> Column:
    return F.trim(F.regexp_replace(decoded(F.regexp_extract(page, TITLE, 1)), SPACES, " "))


#: Limits of what regular expressions read: characters of a page and of a tag, and elements whose end is looked for in a page
#: that is not short.
PAGE_MOST, TAG_MOST, SOUGHT_MOST, SHORT = 300_000, 2000, 32, 20_000


def well_formed(page: Column) -> Column:
    """Whether regular expressions read a page in time in proportion: every tag ends before the next begins, and is short."""
    open_ended = page.rlike(f"<[a-zA-Z/!?][^<>]{{0,{TAG_MOST}}}+(?!>)")
    sought = F.when(F.length(page) > SHORT, F.regexp_count(page, F.lit(r"(?i)<(?:noscript|template|head|title)\b"))).otherwise(0)
    return (F.length(page) <= PAGE_MOST) & ~open_ended & (sought <= SOUGHT_MOST)


SPACE_RUN, LINES, BLANKS = re.compile("[\x20\x09-\x0D]+"), re.compile(r"(?<! ) *+\n[ \n]*+"), re.compile(" {2,}")
REFERENCE = re.compile(r"&(?:#0*([0-9]+);?|#[xX]0*([0-9a-fA-F]+);?|([a-zA-Z][a-zA-Z0-9]*+;))")
LINK_START, TITLE_START = re.compile(r"<a(?=[\s/])", re.I), re.compile(r"<title\b", re.I)
HREF = re.compile(LINK.removeprefix("(?i)<a(?=[\\s/])"), re.I)


def decoded_text(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            return NAMES.get(m[3], m[0])
        digits, base, most = (m[1], 10, 8) if m[1] else (m[2], 16, 7)
        code = int(digits, base) if len(digits) < most else 0
        if code in C1:
            return C1[code]
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "\ufffd"

    return REFERENCE.sub(one, text)


def scanned(page: str) -> tuple[str, list[str], str]:
    """(plain text, links, title) of any page, as the expressions have them, in one pass each."""
    parts, pos = [], 0
    for start, end, kind, tag, _ in tokens(page, frozenset(("script", "style")), frozenset(("noscript", "template", "head"))):
        parts.append(SPACE_RUN.sub(" ", page[pos:start]))
        parts.append(" " if kind in ("comment", "raw") else "\n" if tag in BREAK_TAGS else "")
        pos = end
    parts.append(SPACE_RUN.sub(" ", page[pos:]))
    text = BLANKS.sub(" ", LINES.sub("\n", decoded_text("".join(parts)))).strip(" \n")
    scan, found, pos = Scanner(page), [], 0
    while m := LINK_START.search(page, pos):
        end = scan.tag_end(m.end())
        pos = end if end > 0 else len(page)
        href = HREF.match(page[m.end() : pos])
        if href:
            value = href[1]
            found.append(decoded_text(value[1:-1] if len(value) > 1 and value[0] == value[-1] in "\"'" else value))
    m = TITLE_START.search(page)
    begin = scan.tag_end(m.end()) if m else -1
    end = scan.close_of("title", begin) if begin > 0 else None
    return text, found, SPACE_RUN.sub(" ", decoded_text(page[begin : end[0]])).strip(" ") if end else ""


def scanned_pages(page: Column) -> Column:
    """`scanned` of pages that are not null."""

    def go(pages: pd.Series) -> pd.DataFrame:
        rows = [scanned(p) if p is not None else (None, None, None) for p in pages]
        return pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object), "links": pd.Series([r[1] for r in rows], dtype=object), "title": pd.Series([r[2] for r in rows], dtype=object)})

    return F.pandas_udf(go, "text string, links array<string>, title string")(page)


def responses_of(pages: DataFrame, url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """pages as response records: their columns, `record_id`, `target_uri`, `warc_date`, `http_header`, `payload`, `payload_digest`."""
    p = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(p).cast("string"), F.lit(CRLF))
    out = pages.withColumns({"target_uri": F.col(url), "warc_date": F.lit(date), "http_header": head, "payload": p})
    return out.withColumns({"payload_digest": digest(F.col("payload")), "record_id": record_id(F.lit("response"), F.col("target_uri"), F.sha2("payload", 256))})


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each response, in columns beside those of the response but for its payload and headers."""
    own = [c for c in responses.columns if c not in ("record_id", "target_uri", "warc_date", "http_header", "payload", "payload_digest", "warc_type", "refers_to", "content_type", "block", "block_digest", "content_length", "n_links")]
    r = responses.withColumn("_fine", well_formed(F.col("payload")))
    r = r.withColumn("_scanned", scanned_pages(F.when(~F.col("_fine"), F.col("payload"))))
    either = lambda f, c: F.when(F.col("_fine"), f(F.col("payload"))).otherwise(F.col(f"_scanned.{c}"))
    r = r.withColumn("_links", either(links, "links"))
    envelope = F.struct(
        F.col("target_uri").alias("target"),
        F.col("record_id").alias("source"),
        F.col("payload_digest").alias("payload_digest"),
        F.octet_length("payload").alias("payload_length"),
        F.filter(F.split("http_header", CRLF), lambda x: x != "").alias("headers"),
        either(title, "title").alias("title"),
        F.col("_links").alias("links"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/json").alias("content_type"), F.to_json(envelope, {"ignoreNullFields": "false"}).alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), either(plain_text, "text").alias("block")),
    )
    out = r.withColumn("_k", F.explode(kinds))
    return out.select(
        *own,
        "_k.warc_type",
        record_id(F.col("_k.warc_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        "payload_digest",
        digest(F.col("_k.block")).alias("block_digest"),
        "_k.content_type",
        F.octet_length("_k.block").cast("long").alias("content_length"),
        F.size("_links").cast("long").alias("n_links"),
        "_k.block",
    )


def record_text(df: DataFrame) -> Column:
    """A whole record: header lines of the columns that df has, a blank line, the block."""
    lines = [F.lit("WARC/1.0")] + [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c))) for c, name in FIELDS.items() if c in df.columns]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), F.col("block"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files, one for each partition."""
    records.select(record_text(records).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, block) of records: pieces between version lines are joined until a block has its length."""

    def out(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        columns = [pa.array([r[k].decode("utf-8", "replace") for r in rows], pa.string()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["head", "block"])

    held = b""
    for batch in batches:
        rows = []
        for piece in texts(batch.column("value")):
            piece = held + VERSION + piece if held else piece
            head, _, block = piece.partition(b"\r\n\r\n")
            size = LENGTH.search(head)
            n = int(size[1]) if size else 0
            held = piece if len(block) < n else b""
            if piece and not held:
                rows.append((head + b"\r\n", block[:n]))
        yield out(rows)
    if held:  # the file ends within a block
        head, _, block = held.partition(b"\r\n\r\n")
        yield out([(head + b"\r\n", block)])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: the columns of FIELDS and `block`. Files are split at the version line, plain or compressed; a
    version line within a block is part of it, as its length says.
    """
    raw = spark.read.option("lineSep", VERSION.decode()).text(path)
    found = raw.mapInArrow(_whole_records, "head string, block string")
    fields = {c: F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit("")) for c, name in FIELDS.items()}
    return found.select(*(v.alias(c) for c, v in fields.items()), "block")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    out = derivatives(responses_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return out.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "content_type", "content_length", "n_links", "block")


#: What the SQL uses: it knows these references and double-quoted links only.
SQL_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&laquo;": "«", "&raquo;": "»", "&euro;": "€"}
SQL_HIDDEN = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|noscript\b.*?</noscript\s*>|template\b.*?</template\s*>|head\b.*?</head\s*>)"
SQL_BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
SQL_TAG = r"<[!?/a-zA-Z][^>]*>"
SQL_LINK = r"""(?i)<a\b[^>]*?\shref\s*=\s*"([^"]*)\""""
SQL_TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"


def _sql_text(x: str) -> str:
    names = "".join("replace(" for _ in [*SQL_NAMED, ""])
    pairs = "".join(f", '{n}', '{c.replace(chr(39), chr(39) * 2)}')" for n, c in [*SQL_NAMED.items(), ("&amp;", "&")])
    return f"{names}{x}{pairs}"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _uuid(h: str) -> str:
    return f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"


#: The conversion and metadata records of pages without references by number.
OP5_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, {_uuid("sha256('response|' || coalesce(url, '') || '|' || sha256(html))")} AS source, 'sha256:' || sha256(html) AS payload_digest,
  regexp_extract_all(html, {_quoted(SQL_LINK)}, 1) AS links,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, {_quoted(SQL_HIDDEN)}, ' ', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), {_quoted(SQL_BREAKS)}, chr(10), 'g'), {_quoted(SQL_TAG)}, '', 'g') AS t,
  regexp_extract(html, {_quoted(SQL_TITLE)}, 1) AS title FROM p),
c AS (SELECT *, trim(regexp_replace(regexp_replace({_sql_text("t")}, ' *' || chr(10) || '[ ' || chr(10) || ']*', chr(10), 'g'), ' +', ' ', 'g'), ' ' || chr(10)) AS text,
  to_json({{'target': url, 'source': source, 'payload_digest': payload_digest, 'payload_length': octet_length(encode(html)), 'headers': ['HTTP/1.1 200 OK', 'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || octet_length(encode(html))],
    'title': trim(regexp_replace({_sql_text("title")}, '[\\x20\\x09-\\x0D]+', ' ', 'g')), 'links': list_transform(links, lambda x: {_sql_text("x")})}}) AS meta FROM r),
k AS (SELECT *, 'metadata' AS warc_type, 'application/json' AS content_type, CAST(meta AS VARCHAR) AS block FROM c
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM c)
SELECT page_id, warc_type, {_uuid("sha256(warc_type || '|' || source)")} AS record_id, source AS refers_to, url AS target_uri, payload_digest,
  'sha256:' || sha256(block) AS block_digest, content_type, CAST(octet_length(encode(block)) AS BIGINT) AS content_length, CAST(len(links) AS BIGINT) AS n_links, block FROM k
"""
