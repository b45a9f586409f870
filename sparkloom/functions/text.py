"""Text functions, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: masks of personal data
PHONE, PHONE_MASK = r"(?<!\d)1[3-9]\d{9}(?!\d)", "1***-****-****"
ID_CARD, ID_MASK = r"(?<!\d)\d{17}[\dXx](?![\dXx])", "*" * 18
EMAIL, EMAIL_MASK = r"[\w.-]+@[\w.-]+\.[a-zA-Z]{2,}", "***@***.***"


# fixed values: what a question that tries to instruct the model says
INJECTION = ("ignore previous", "ignore all", "forget everything", "system prompt", "you are now", "new instructions", "忽略之前的", "忘记所有", "新的指令", "你的系统提示词")


#: What Java takes for white space, and so for blank: separators that may be broken at, and the controls 09-0D and 1C-1F.
BLANK = r"\t-\r\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}"


def has_text(text: Column) -> Column:
    """Whether a text holds anything but white space; null does not."""
    return F.coalesce(text.rlike(f"[^{BLANK}]"), F.lit(False))


def stripped(text: Column) -> Column:
    """A text without the white space at its ends, tabs and newlines too."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+\\z", "")


def trimmed(text: Column) -> Column:
    """A text without the controls and spaces (00-20) at its ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; a run of Han characters gives its pairs of neighbours, or itself if it is one."""
    def runs(x: Column) -> Column:
        return F.array_remove(F.split(x, r"[^\p{L}\p{N}]+"), "")

    def pairs(t: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(2)))
        return F.when(t.rlike(r"^\p{IsHan}"), two).otherwise(F.array(t))

    low = F.lower(text)
    apart = runs(F.regexp_replace(low, r"(\p{IsHan}+)", " $1 "))
    # Han characters begin at 2E80; the range is looked for much faster than the script, and not at all in texts of one byte a character
    han = (F.octet_length(low) > F.length(low)) & low.rlike(r"[\x{2E80}-\x{10FFFF}]") & low.rlike(r"\p{IsHan}")
    return F.when(han, F.flatten(F.transform(apart, pairs))).otherwise(runs(low))


def sanitize(text: Column) -> Column:
    """Phone, then identity-card numbers, then e-mail addresses masked; apply once.

    Only texts with a run of 11 digits, or with an at sign, are gone through for what these are part of.
    """
    out = F.when(text.rlike(r"\d{11}"), F.regexp_replace(F.regexp_replace(text, PHONE, PHONE_MASK), ID_CARD, ID_MASK)).otherwise(text)
    return F.when(F.contains(out, F.lit("@")), F.regexp_replace(out, EMAIL, EMAIL_MASK)).otherwise(out)


def terms(csv: str, lower: bool = True) -> list[str]:
    """A configured list: split at commas, trimmed, blanks dropped."""
    return [t.lower() if lower else t for t in (x.strip() for x in csv.split(",")) if t]


def has_any(text: Column, words: list[str], ignore_case: bool) -> Column:
    """Whether the text holds one of the words; with none it never does."""
    where = F.lower(text) if ignore_case else text
    out = F.lit(False)
    for w in words:
        out = out | F.contains(where, F.lit(w))
    return F.coalesce(out, F.lit(False))


def token_estimate(text: Column) -> Column:
    return (F.length(text) / F.lit(2.5)).cast("int")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def title(text: Column, n: int = 50, blank: str = "untitled") -> Column:
    """A text's first ``n`` characters without the controls and spaces around it; of a text that holds nothing the placeholder."""
    return F.when(has_text(text), truncate(trimmed(text), n)).otherwise(F.lit(blank))


def snippet(text: Column, n: int = 120) -> Column:
    return truncate(F.regexp_replace(text, r"\s+", " "), n)


def strip_fence(text: Column) -> Column:
    """What a closed code fence holds, without the white space at its ends; other texts as they are, null as empty."""
    t = stripped(text)
    opened, closed = F.locate("\n", t), t.startswith("```") & t.endswith("```") & (F.length(t) > 6)
    inner = stripped(F.substr(t, opened + 1, F.greatest(F.length(t) - 3 - opened, F.lit(0))))
    return F.when(closed & (opened > 0), inner).otherwise(F.coalesce(text, F.lit("")))


def first_non_blank(*cols: Column) -> Column:
    """The first text that holds something, as it is; else the empty text."""
    return F.coalesce(*[F.when(has_text(c), c) for c in cols], F.lit(""))


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def mime_kind(mime: Column) -> Column:
    # fixed values: accepted kinds
    kinds = {
        "application/pdf": "PDF",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX",
        "text/markdown": "MD",
        "text/plain": "TXT",
        "text/html": "HTML",
    }
    out = F.lit("UNKNOWN")
    for k, v in kinds.items():
        out = F.when(mime == k, F.lit(v)).otherwise(out)
    return out


def markdown_tables(text: Column) -> Column:
    """Lines that start with a pipe and hold a rule."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("|") & F.contains(x, F.lit("---"))))


def is_pdf(name: Column) -> Column:
    return F.lower(name).endswith(".pdf")


def extension(name: Column) -> Column:
    """What follows the last dot, as it is written; empty without one, or without a name."""
    return F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1)).otherwise(F.lit(""))


def page_number(raw: Column) -> Column:
    """A whole number, or a text of one; else null."""
    return F.when(F.trim(raw).rlike(r"^[+-]?\d{1,9}$"), F.trim(raw).cast("int"))


def stage_percent(stage: Column) -> Column:
    # fixed values: how far a document is at the beginning of a stage
    percents = {"READING": 5, "TRANSFORMING": 15, "PERSISTING": 30, "EMBEDDING": 50, "INDEXING": 85, "COMPLETED": 100, "FAILED": 0}
    out = F.lit(None).cast("int")
    for name, percent in percents.items():
        out = F.when(stage == name, F.lit(percent)).otherwise(out)
    return out


def size_shown(n: Column) -> Column:
    """Bytes, kilobytes or megabytes; a dash for none."""
    kb, mb = F.format_string("%.1f KB", n / 1024.0), F.format_string("%.1f MB", n / 1048576.0)
    return F.when(n.isNull() | (n == 0), F.lit("—")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, kb).otherwise(mb)


def score_shown(v: Column) -> Column:
    """Two decimals from ten on, else four; a dash for none."""
    return F.when(v.isNull(), F.lit("—")).when(F.abs(v) >= 10, F.format_string("%.2f", v)).otherwise(F.format_string("%.4f", v))


def time_shown(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("—"))


def bar_width(v: Column, most: Column) -> Column:
    """Percent of the most, at least two; none for none."""
    return F.when(v.isNull(), F.lit(0.0)).otherwise(F.greatest(F.abs(v) / F.greatest(F.abs(most), F.lit(1e-9)) * 100, F.lit(2.0)))


def bar_height(v: Column, most: Column) -> Column:
    """Parts of 64 of the most, at least six; six for none."""
    return F.greatest(F.coalesce(v / F.greatest(most, F.lit(1)) * 64, F.lit(0.0)), F.lit(6.0))
