"""Mailbox files, header fields and MIME bodies as tables."""

import email
import email.policy
from email.utils import parseaddr, parsedate_to_datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "seq BIGINT, date TIMESTAMP, from_name STRING, from_email STRING, to_name STRING, to_email STRING, message_id STRING, subject STRING, in_reply_to STRING, text STRING"


def scan_mbox(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """SRC1, SRC2: ``file``, ``pos``, ``raw``; a message starts at a line ``From ``.

    Files are split like other texts, so a mailbox of any size spreads over many tasks. ``pos`` grows along a file: the
    block's first byte and the number of the message in the block, which is its number in the file where that is one
    block. What precedes the first such line is a message of its own; bytes that aren't text become U+FFFD.
    """
    meta = lambda f: F.col(f"_metadata.{f}")
    parts = spark.read.option("lineSep", "\nFrom ").option("encoding", encoding).text(path)
    # of files in several blocks the last in which a message begins: a number a file, as the driver's listing has them too
    cut = parts.where(meta("file_block_length") < meta("file_size")).groupBy(meta("file_path").alias("file")).agg(F.max(meta("file_block_start")).alias("block"))
    last = spark.sparkContext.broadcast({r.file: r.block for r in cut.collect()})
    rows = parts.select(meta("file_path").alias("file"), meta("file_block_start").alias("block"), F.make_valid_utf8("value").alias("value"))

    def run(batches):
        held, n = None, 0  # the row before, which is the last of its file if the next is of another block
        for batch in batches:
            out = []
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held[:2] != (file, block):
                    out += _message(held, n, True)
                    n = 0
                else:
                    made = _message(held, n, False)
                    n += len(made)
                    out += made
                first = block == 0 and (held is None or held[:2] != (file, block))
                held = (file, block, block == last.value.get(file, block), value, first)
            yield _raw(out)
        yield _raw(_message(held, n, True))

    return rows.mapInArrow(run, "file STRING, pos BIGINT, raw STRING")


def _message(held, n: int, last: bool) -> list[tuple]:
    """The message of a piece between two lines ``From ``, or nothing if it is blank."""
    if held is None:
        return []
    file, block, ends, value, first = held
    if last and ends:
        value = value.removesuffix("\n")
    if not first or value.startswith("From "):
        value = value.partition("\n")[2]
    return [(file, block + n, value.split("\0", 1)[0])] if value.strip() else []


def _raw(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["file", "pos", "raw"])


def _address(value: str | None) -> tuple[str | None, str | None]:
    if value is None:
        return None, None
    # the name is decoded after it was split off, since it may hold commas, quotation marks and brackets
    name, address = parseaddr(str(value))
    return _decoded(name) or None, _decoded(address) or None


def _decoded(v) -> str | None:
    return None if v is None else str(email.header.make_header(email.header.decode_header(str(v)))) if "=?" in str(v) else str(v)


def _text_part(m) -> str | None:
    """MIM5-7: the first text/plain part, decoded by its own headers; else the whole body as it stands."""
    for part in m.walk():
        if part.get_content_type() == "text/plain" and not part.is_multipart():
            break
    else:
        part = m
    # the scan has decoded what isn't encoded for transfer
    if isinstance(whole := part.get_payload(), str) and not whole.isascii():
        return whole
    data = part.get_payload(decode=True)
    if data is None:
        return None if part.is_multipart() else str(part.get_payload())
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def parse_message(raw: str) -> tuple:
    """SRC5, SRC6: the fields of ``MESSAGE`` after ``seq``; In-Reply-To is '' if absent, an unreadable date null; the last of repeated headers counts."""
    m = email.message_from_string(raw, policy=email.policy.compat32)
    last = lambda k: (m.get_all(k) or [None])[-1]
    try:
        date = pd.Timestamp(parsedate_to_datetime(_decoded(last("Date"))))
        date = date.tz_convert("UTC").tz_localize(None) if date.tzinfo else date
    except (TypeError, ValueError, IndexError, OverflowError):
        date = pd.NaT
    return (date, *_address(last("From")), *_address(last("To")), _decoded(last("Message-ID")), _decoded(last("Subject")), _decoded(last("In-Reply-To")) or "", _text_part(m))


def parse_messages(raw: DataFrame) -> DataFrame:
    """``MESSAGE`` of rows ``seq raw``; a null ``raw`` gives nulls."""

    def run(batches):
        for df in batches:
            rows = [(s, *(parse_message(r) if isinstance(r, str) else (pd.NaT, *[None] * 8))) for s, r in zip(df["seq"], df["raw"])]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in MESSAGE.split(", ")]).astype({"date": "datetime64[us]"})

    return raw.select("seq", "raw").mapInPandas(run, MESSAGE)


def mime_fields(raw: Column) -> list[Column]:
    """MIM1-3: charset, transfer encoding and content type by expressions, with their defaults."""
    first = lambda p, d: F.coalesce(F.nullif(F.regexp_extract(raw, p, 1), F.lit("")), F.lit(d))
    return [
        first(r"charset=\"?([^\";\s]+)", "UTF-8").alias("charset"),
        first(r"Content-[Tt]ransfer-[Ee]ncoding: ([^;\s]+)", "8bit").alias("transfer_encoding"),
        F.nullif(F.trim(F.regexp_extract(raw, r"(?i)Content-Type:\s*([^;\n]+)", 1)), F.lit("")).alias("content_type"),
    ]


def render(df: DataFrame) -> DataFrame:
    """SNK12: messages as text; null fields are empty."""
    f = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = [F.concat(F.lit(k + ": "), f(c)) for k, c in (("Subject", "subject"), ("Message-ID", "message_id"), ("In-Reply-To", "in_reply_to"))]
    who = lambda k, n, e: F.concat(F.lit(k + ": "), f(n), F.lit(" <"), f(e), F.lit(">"))
    return df.select("seq", F.concat_ws("\n", *lines, who("From", "from_name", "from_email"), who("To", "to_name", "to_email"), F.lit(""), f("text")).alias("raw"))


def _words(c: Column) -> Column:
    """Encoded words of at most 44 bytes each."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s).{1,11}"), F.lit(0)), lambda x: F.concat(F.lit("=?utf-8?b?"), F.base64(F.encode(x, "utf-8")), F.lit("?="))), "\n ")


def _header(name: str, c: Column) -> Column:
    """A header line, null if ``c`` is; what plain ASCII can't carry is encoded."""
    plain = c.rlike(r"\A(?:[!-~](?:[ -~]{0,900}[!-~])?)?\z") & ~F.contains(c, F.lit("=?"))
    return F.concat(F.lit(name + ": "), F.when(plain, c).otherwise(_words(c)))


def _party(name: str, who: Column, address: Column) -> Column:
    """An address header, null without name and address."""
    shown = F.when(who.rlike(r"\A[A-Za-z0-9]+(?: [A-Za-z0-9]+)*\z"), who).otherwise(_words(who))
    return F.when(who.isNotNull() | address.isNotNull(), F.concat(F.lit(name + ": "), F.coalesce(F.concat(shown, F.lit(" ")), F.lit("")), F.lit("<"), F.coalesce(address, F.lit("")), F.lit(">")))


def render_mbox(df: DataFrame) -> DataFrame:
    """``seq``, ``raw`` of messages as a mailbox keeps them; the number is the header ``X-Seq``, null fields have no header.

    Bodies take turns by ``seq``: as they stand with lines ``From `` quoted, base64, base64 in Latin-1 where it has all
    characters, and as second part beside HTML. A null text is an empty body.
    """
    c = F.col
    text = F.coalesce(c("text"), F.lit(""))
    coded = lambda charset: F.base64(F.encode(text, charset))
    kind = "Content-Type: text/plain; charset="
    base64 = lambda charset: F.concat(F.lit(f"{kind}{charset}\nContent-Transfer-Encoding: base64\n\n"), coded(charset))
    whole = F.concat(F.lit(f"{kind}utf-8\nContent-Transfer-Encoding: 8bit\n\n"), F.regexp_replace(text, r"(?dm)^(>*From )", ">$1"))
    parts = F.concat(F.lit('Content-Type: multipart/alternative; boundary="=_b"\n\n--=_b\nContent-Type: text/html\n\n<p>no</p>\n--=_b\n'), base64("utf-8"), F.lit("\n--=_b--"))
    turn = F.pmod(F.coalesce("seq", F.lit(0)), F.lit(4))
    latin = text.rlike(r"\A[\x00-\xff]*+\z")
    body = F.when((turn == 0) & ~F.contains(text, F.lit("\0")), whole).when((turn == 2) & latin, base64("iso-8859-1")).when(turn == 3, parts).otherwise(base64("utf-8"))
    heads = [_header("X-Seq", c("seq").cast("string")), _header("Date", c("msg_date")), _header("Subject", c("subject")), _header("Message-ID", c("message_id")), _header("In-Reply-To", c("in_reply_to"))]
    return df.select("seq", F.concat_ws("\n", *heads, _party("From", c("from_name"), c("from_email")), _party("To", c("to_name"), c("to_email")), F.lit("MIME-Version: 1.0"), body).alias("raw"))


def unquoted(raw: Column) -> Column:
    """A scanned message without the quoting of its lines ``From ``."""
    return F.regexp_replace(raw, r"(?dm)^>(>*From )", "$1")
