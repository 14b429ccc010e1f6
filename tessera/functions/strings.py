"""String expressions as columns. Patterns with word classes name their Unicode classes outright."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small English stop words.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)
#: What is redacted in logs, blind to case; the first group stays.
REDACTIONS = (
    r"(api[_-]?key\s*[:=]\s*)['\"]?[\w\-]{10,}['\"]?",
    r"(token\s*[:=]\s*)['\"]?[\w\-]{10,}['\"]?",
    r"(password\s*[:=]\s*)['\"]?[^\s'\"]{4,}['\"]?",
    r"(secret\s*[:=]\s*)['\"]?[\w\-]{10,}['\"]?",
    r"(Bearer\s+)[\w\-\.]{10,}",
    r"(authorization\s*[:=]\s*)['\"]?Bearer\s+[\w\-\.]+['\"]?",
)
#: What stands between words.
NO_WORD = "[^\\p{L}\\p{N}]+"
#: The shape of a storage key, and of tokens without content.
S3_KEY = r"^\d+/\d+/\w+/\d+/.+$"
EMPTY_TOKEN = r"^<.*$|^\s+$|^(?!.*\d)(?!▁)[^\w\s]+$|^_.*$|^Question$|^▁$"


def sanitize(text: Column) -> Column:
    """Without control characters other than tab, newline and return."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")


def slug(text: Column, chars: int = 30) -> Column:
    """Non-alphanumerics as underscores, cut, then stripped of them, lower; nothing left: document."""
    cut = F.substring(F.regexp_replace(text, "[^a-zA-Z0-9]", "_"), 1, chars)
    stripped = F.lower(F.regexp_replace(cut, "^_+|_+$", ""))
    return F.coalesce(F.nullif(stripped, F.lit("")), F.lit("document"))


def short_md5(data: Column, chars: int = 12) -> Column:
    return F.substring(F.md5(data.cast("binary")), 1, chars)


def page_doc_id(name: Column, data: Column, page: Column) -> Column:
    return F.concat(slug(name), F.lit("_"), short_md5(data), F.lit("_page_"), page.cast("string"))


def snippet(text: Column, page: Column, file: Column, label: Column | None = None, chars: int = 200) -> Column:
    """The first characters with an ellipsis; an empty text names its page; a label goes first."""
    whole = F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)
    whole = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.concat(F.lit("Page "), page.cast("string"), F.lit(" of "), file)).otherwise(whole)
    return whole if label is None else F.concat(F.lit("["), label, F.lit("] "), whole)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """What follows the last dot, lower; no dot: null."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, "\\."), -1)))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(scheme, host, file name), null without a scheme and a host."""
    scheme, host, path = (F.try_parse_url(url, F.lit(p)) for p in ("PROTOCOL", "HOST", "PATH"))
    ok = scheme.isNotNull() & host.isNotNull()
    return F.when(ok, scheme), F.when(ok, host), F.when(ok, basename(F.coalesce(path, F.lit(""))))


def without_stop_words(text: Column) -> Column:
    """The words that aren't stop words; if all are, the text as it is."""
    kept = F.filter(F.split(text, "\\s+"), lambda w: (w != "") & ~F.lower(w).isin(*STOP_WORDS))
    return F.when(F.size(kept) > 0, F.concat_ws(" ", kept)).otherwise(text)


def outgoing_type(column: Column) -> Column:
    return F.regexp_replace(column, "_id$", "")


def incoming_type(table: Column) -> Column:
    """The table's name without any final s."""
    return F.regexp_replace(table, "s+$", "")


def plural(base: Column) -> Column:
    """Where a y ends it, ies; where an s ends it, es; else s."""
    return F.when(base.endswith("y"), F.regexp_replace(base, "y$", "ies")).when(base.endswith("s"), F.concat(base, F.lit("es"))).otherwise(F.concat(base, F.lit("s")))


def column_kind(name: Column, kind: Column, json_kind: str = "jsonb") -> Column:
    """Of a column that refers to files: jsonb_s3_map, s3_key or url; else null."""
    text = kind.isin("text", "character varying", "varchar", "string")
    return (
        F.when((kind == json_kind) & name.rlike("_s3_keys$"), F.lit("jsonb_s3_map"))
        .when(text & (name.rlike("^s3_key$") | name.rlike("_s3_key$") | name.rlike("^s3_")), F.lit("s3_key"))
        .when(text & (name.rlike("^url$") | name.rlike("_url$")), F.lit("url"))
    )


def s3_key_shape(key: Column) -> Column:
    return key.rlike("(?U)" + S3_KEY)


def redact(text: Column) -> Column:
    for pattern in REDACTIONS:
        text = F.regexp_replace(text, "(?i)" + pattern, "$1[REDACTED]")
    return text


def glob_regex(glob: str) -> str:
    """A shell pattern as an anchored regular expression: * and ? stand for any text and character."""
    out = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not (c.isalnum() or c == "_") else c) for c in glob)
    return f"^{out}$"


def matches_any_glob(name: Column, globs: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | name.rlike(glob_regex(g))
    return found


def tags(csv: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def truthy(flag: Column) -> Column:
    return F.coalesce(F.lower(F.trim(flag)).isin("on", "true", "1", "yes"), F.lit(False))


def line_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("<br>"))


def token_text(token: Column) -> Column:
    return F.replace(token, F.lit("▁"), F.lit(""))


def is_content_token(token: Column) -> Column:
    """Whether a query token is worth a similarity map. Word classes take all of Unicode."""
    return ~token.rlike("(?U)" + EMPTY_TOKEN)


def ellipsis(text: Column, chars: int) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars - 1), F.lit("\u2026"))).otherwise(text)


def initials(name: Column) -> Column:
    words = F.filter(F.split(name, "[\\s-]+"), lambda w: w != "")
    return F.upper(F.concat_ws("", F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1))))


def relative_date(at: Column, now: Column) -> Column:
    """How long ago, of two epoch seconds: minutes, hours, days below a week, else month and day."""
    s = now - at
    ago = lambda per, unit: F.concat(F.floor(s / per).cast("string"), F.lit(f"{unit} ago"))
    day = F.date_format(F.timestamp_seconds(at), "MMM d")
    return F.when(s < 60, "just now").when(s < 3600, ago(60, "m")).when(s < 86_400, ago(3600, "h")).when(s < 7 * 86_400, ago(86_400, "d")).otherwise(day)


def counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(word)).otherwise(F.lit(word + "s")))


def highlight(text: Column, pattern: str) -> Column:
    """Whole-word, case-blind matches in bold."""
    return F.regexp_replace(text, f"(?i)(?<![\\p{{L}}\\p{{N}}])({pattern})(?![\\p{{L}}\\p{{N}}])", "<strong>$1</strong>")


def without_fences(text: Column) -> Column:
    """The body of a fenced code block, or the text trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", ""))


def content_text(fields: list[Column]) -> Column:
    """The string fields that aren't blank, without white space at their ends, joined by spaces."""
    bare = lambda f: F.regexp_replace(f, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")
    return F.concat_ws(" ", *[F.nullif(bare(f), F.lit("")) for f in fields])


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")
