"""Texts that stop before their file's end.

Each text is read once by a stack automaton for its kind (told from the text itself,
names and labels are often wrong): brackets, quotes, comments, markup, escapes and
broken characters left open at the end, words cut in the middle, and the way the last
line ends.  What isn't wrong in itself is held against baselines over all documents: how
texts of a kind, by source, usually end, at which length a source's field is full, and
in blocks of which size a source was cut when a transfer broke off.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.mixing import source_name
from tidemark.session import broadcast_if_small, shared_dir

#: Share of texts of a kind that end in a usual way from which another ending is a cut, and
#: from how many texts of other sources on that is asked of them.
USUAL, LEAST_TEXTS = 0.8, 20
#: Texts that fill a field to the same length, and their number against chance.
FULL_TEXTS, FULL_RATIO = 3, 5.0
#: Lengths to either side whose texts tell what chance would give.
NEAR = 100
BLOCKS = (4096, 2048, 1024, 512, 256)
BLOCK_TEXTS, BLOCK_SHARE = 3, 0.2
#: How far from the end the mark that a cut leaves can begin.
MARK_REACH = 200

_MARK = re.compile(r"\s*(?:\[(?:\.\.\.|…)?\s*(?:cut|truncated|snip|more)?\s*(?:\.\.\.|…)?\]|<(?:truncated|cut)>)\s*$", re.I)
_DOTS = re.compile(r"(?:\.\.\.|…)\s*$")
_PY_LINE = re.compile(r"^[ \t]*(?:def \w+|class \w+[^\n{;]*:[ \t]*$|elif |import [\w.]+[ \t]*$|from [\w.]+ import |(?:if|while|for|else|try|with)\b[^\n{;]*:[ \t]*$)", re.M)
_BRACE_LINE = re.compile(r"[{};][ \t]*$", re.M)
_YAML_LINE = re.compile(r"^[ \t]*(?:- )?[\w.\"'-]+:(?:[ \t]+\S.*)?$", re.M)
_BRACE = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\\?\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\\?\Z)|`(?:\\.|[^`\\])*(?:`|\\?\Z)|[()\[\]{}]""", re.S)
_BRACE_ONE_LINE = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\\?\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\\?\Z)|`(?:\\.|[^`\\])*(?:`|\\?\Z)|[()\[\]{}]""", re.S)
_PYTHON = re.compile(r"""\#[^\n]*|\"{3}(?:\\.|.)*?(?:\"{3}|\Z)|'{3}(?:\\.|.)*?(?:'{3}|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\\?\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\\?\Z)|[()\[\]{}]""", re.S)
_CLOSES = {")": "(", "]": "[", "}": "{"}
_WORD = re.compile(r"\w+")
_OPEN_END = re.compile(r"(?:[-+*/%=<>&|^,.(\[{\\:]|\b(?:in|and|or|not|is|if|else|elif|while|for|def|class|import|from|as|lambda|with|assert|del|global))\s*$")
_PY_BODY = re.compile(r"^[ \t]+(?:assert |raise |return [\w.]+$|yield |\"{3}|'{3}|[\w.]+ = (?!.*;$)|[\w.]+\([^;{}]*\)$)")
_PY_DICT = re.compile(r"^[ \t]*\w+ = (?:\{.*\}|\[.*\])$")
_HEAD = re.compile(r"(?:def|class|if|elif|else|for|while|with|try|except|finally)\b(?! *=)")
_LAST_STATEMENT = re.compile(r"^(?:return|raise|pass|yield|break|continue)\b")


def _kind_of_block(t: str, weak: bool = False) -> str:
    """The kind a stretch of text without blank lines speaks for, or nothing."""
    lines = [x for x in t.split("\n") if x.strip()]
    code = [x for x in lines if not x.lstrip().startswith(("#", "//"))]
    if not code:
        return ""
    brace = sum(bool(_BRACE_LINE.search(x)) and not _PY_DICT.match(x) for x in code)
    python = sum(bool(_PY_LINE.match(x) or _PY_BODY.match(x)) for x in code)
    if brace > python or brace and brace >= python and t.count(";") + t.count("{\n") > 1:
        return "brace"
    if python:
        return "python"
    if sum(bool(_YAML_LINE.match(x)) for x in code) * 10 >= 7 * len(code):
        return "yaml"
    if len(code) <= 2 and max(map(len, code)) > 200 and t.count("{") + t.count(";") > 4:
        return "brace"
    if re.match(r"(?:export )?(?:function|const|let|class|func|static|import|package|var|type|struct|int|void)\b", code[0]) and (weak or re.search(r"[(){};]", code[0])):
        return "brace"
    first = code[-1].lstrip("> ")
    if len(code[-1].split()) >= 4 and not re.search(r"[;={}\[\]]", code[-1]) and first[:1].isupper() or first.startswith("#"):
        return "prose"
    return ""


def kind_of_text(t: str) -> str:
    """``json``, ``markup``, ``python``, ``brace`` (C, Go, Java, JavaScript), ``yaml`` or ``prose``.

    The text's end decides: passages of other files stand within texts of every kind, as
    blocks of their own, and say nothing of how the file itself has to end.
    """
    if re.match(r'\s*(?:\{\s*(?:"|\}|$)|\[\s*(?:["{\[\]]|$))', t):
        return "json"
    if _DOCUMENT.match(t):
        return "markup"
    blocks = [x for x in re.split(r"\n[ \t]*(?:\n[ \t]*)+", t) if x.strip()]
    for block in reversed(blocks):
        if kind := _kind_of_block(block):
            return kind
    for block in reversed(blocks):
        if kind := _kind_of_block(block, weak=True):
            return kind
    first = next((x for x in t.splitlines() if x.strip()), "")
    return "brace" if re.match(r"\s*(?://|/\*)", first) else "prose"


_TOP_LEVEL = re.compile(r"(?:\A|\n[ \t]*\n)(?=[A-Za-z_@])")


def _last_unit(t: str) -> str:
    """The text from the last line that begins a construct at the left margin.

    Such a line after a blank one stands outside of all brackets, so what a passage
    inserted before it left open doesn't matter.
    """
    start = 0
    for m in _TOP_LEVEL.finditer(t):
        start = m.end()
    return t[start:]


def _open_at_end(t: str, tokens: re.Pattern) -> str:
    """What the automaton has open at the end: a bracket, ``quote``, ``comment`` or nothing."""
    stack: list[str] = []
    end = len(t)
    text_end = len(t.rstrip())
    for m in tokens.finditer(t):
        x = m.group()
        c = x[0]
        if c in "([{":
            stack.append(c)
        elif c in ")]}":
            if stack and stack[-1] == _CLOSES[c]:
                stack.pop()
            elif _CLOSES[c] in stack:  # what was opened inside is given up
                while stack.pop() != _CLOSES[c]:
                    pass
        elif m.end() >= text_end:
            if x.startswith("/*"):
                if not x.endswith("*/") or len(x) < 4:
                    return "comment"
            elif x.startswith(('"""', "'''")):
                if not x.endswith(x[:3]) or len(x) < 6:
                    return "quote"
            elif c in "\"'`" and (len(x) < 2 or x[-1] != c or m.end() > end):
                return "quote"
    return stack[-1] if stack else ""


#: A text that is markup as a whole, and what such a text consists of.
_DOCUMENT = re.compile(r"\s*<(?:!doctype\b|\?xml\b|html\b|svg\b)", re.I)
_TAGS = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[?!].*?(?:>|\Z)|<(/?)([A-Za-z][\w:.-]*)((?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^<>"'])*)(>|(?=<)|\Z)|<\Z""", re.S | re.I)
#: HTML elements that have no end tag, or need none (fixed values).
_UNCLOSED = frozenset("area base br col embed hr img input link meta param source track wbr body colgroup dd dt head html li optgroup option p rb rp rt tbody td tfoot th thead tr".split())
#: Elements that prose writes with both tags.
_PAIRED = re.compile(r"<(/?)(details|summary|table|ul|ol|blockquote|pre|picture)\b[^<>]*>", re.I)
_CODE_IN_PROSE = re.compile(r"^[ \t]*```.*?(?:^[ \t]*```|\Z)|`[^`\n]*`", re.S | re.M)


def _open_markup(t: str) -> str:
    """What a markup document has open at its end: ``comment``, ``markup`` or nothing."""
    html, stack = re.match(r"\s*(?:<\?.*?>\s*)?<(?:!doctype html|html)\b", t, re.I | re.S) is not None, []
    for m in _TAGS.finditer(t):
        x = m.group()
        if x.startswith(("<!--", "<![CDATA[")):
            if not x.endswith(("-->", "]]>")):
                return "comment"
        elif m[1]:
            if not re.search(r"</\w+\s*>$", x):
                return "markup"
        elif m[3] is None:
            if not x.endswith(">"):
                return "markup"
        elif not m[5] and m.end() >= len(t):
            return "markup"
        elif html and m[3].lower() in _UNCLOSED or m[4].endswith("/"):
            continue
        elif not m[2]:
            stack.append(m[3].lower() if html else m[3])
        else:
            name = m[3].lower() if html else m[3]
            if name in stack:  # what was opened inside is given up
                while stack.pop() != name:
                    pass
    return "markup" if stack else ""


def _open_in_prose(t: str) -> bool:
    """Whether prose leaves a code fence, or an element of those written in pairs, open."""
    if len(re.findall(r"^[ \t]*```", t, re.M)) % 2:
        return True
    stack: list[str] = []
    for m in _PAIRED.finditer(_CODE_IN_PROSE.sub("", t)) if "<" in t else ():
        name = m[2].lower()
        if not m[1]:
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
    return bool(stack)


def _without_comments(t: str, mark: str) -> list[str]:
    """Lines that aren't blank or wholly comment."""
    return [x for x in t.split("\n") if (s := x.strip()) and not s.startswith(mark)]


def _cut_word(t: str) -> bool:
    """Whether the last word occurs only there and begins another word of the unit."""
    begin = end = len(t.rstrip())
    while begin and (t[begin - 1].isalnum() or t[begin - 1] == "_"):
        begin -= 1
    last, before = t[begin:end], t[:begin]
    if not last or last.isdigit():
        return False
    return re.search(rf"\b{re.escape(last)}\b", before) is None and re.search(rf"\b{re.escape(last)}\w", before) is not None


def examine(text: str) -> tuple[str, str, bool, int, bool]:
    """(kind, cut, ends_usually, length without mark and last line break, bare).

    ``cut`` names what proves by itself that the text goes on, else it is empty;
    ``ends_usually`` is whether the last line ends as finished texts of its kind do;
    ``bare`` is whether the text ends without a line break or in a mark.
    """
    t = text.replace("\r\n", "\n")
    core_length = len(text[:-1] if text.endswith("\n") else text)
    tail = t[-MARK_REACH:]
    marked = _MARK.search(tail) if tail.rstrip().endswith(("]", ">")) and re.search(r"\.\.\.|…|cut|trunc|snip", t[-24:], re.I) else None
    dots = _DOTS.search(tail)
    bare = not text.endswith("\n")
    if not t.strip():
        return "empty", "", True, core_length, False
    if marked:
        core_length = max(0, len(text) - MARK_REACH) + len(_MARK.sub("", text[-MARK_REACH:]))
        t = t[: len(t) - len(tail) + marked.start()]
        return kind_of_text(t), "mark", True, core_length, True
    if dots:
        core_length = max(0, len(text) - MARK_REACH) + len(_DOTS.sub("", text[-MARK_REACH:]))
    kind = kind_of_text(t)
    if t.rstrip("\n").endswith("�"):
        return kind, "broken character", True, core_length, bare
    if re.search(r"\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?$", t) and kind != "prose":
        return kind, "broken escape", True, core_length, bare
    if kind in ("json", "brace"):
        unit = t if kind == "json" else _last_unit(t)
        left = _open_at_end(unit, _BRACE)
        if left and kind == "brace" and t.strip().count("\n") * 400 <= len(t):
            # Code on one line: a comment joined with what follows hides no brackets.
            left = _open_at_end(unit, _BRACE_ONE_LINE)
        if left:
            return kind, f"open {left}", True, core_length, bare
        one_line = t.strip().count("\n") * 400 <= len(t)
        code = _BRACE.sub(lambda m: "" if m.group().startswith("/*") else m.group(), t) if "/*" in t else t
        lines = _without_comments(code, "//")
        if not one_line and not lines:
            return kind, "", False, core_length, bare
        last = (t if one_line else lines[-1]).rstrip()
        if not one_line:
            last = re.sub(r"(?<!\s)\s+//[^\"'`]*$", "", last)
        if dots and last.endswith(("...", "…")):
            return kind, "mark", True, core_length, True
        return kind, "", last.endswith(("}", "]")) if kind == "json" else last.endswith(("}", ";")) or last.startswith("#"), core_length, bare
    if kind == "python":
        if left := _open_at_end(_last_unit(t), _PYTHON):
            return kind, f"open {left}", True, core_length, bare
        lines = _without_comments(t, "#")
        if not lines:
            return kind, "", False, core_length, bare
        last = lines[-1].rstrip()
        if dots and last.endswith(("...", "…")) and last.strip() != "...":
            return kind, "mark", True, core_length, True
        statement = last.strip()
        if _OPEN_END.search(statement):
            return kind, "open statement", True, core_length, bare
        if t.rstrip().endswith(statement) and _cut_word(_last_unit(t.rstrip())):
            return kind, "cut word", True, core_length, bare
        if _HEAD.match(statement) and not statement.endswith(":") and ": " not in statement:
            return kind, "open statement", True, core_length, bare
        if statement == "return" and bare:
            return kind, "open statement", True, core_length, bare
        if last[0] not in " \t":
            return kind, "", not re.fullmatch(r"\w+(?: \w+)?|@[\w.]*", statement) or statement.startswith("import "), core_length, bare
        return kind, "", bool(_LAST_STATEMENT.match(statement)) or statement.endswith("..."), core_length, bare
    if kind == "yaml":
        lines = _without_comments(t, "#")
        if not lines:
            return kind, "", True, core_length, bare
        last = lines[-1].rstrip()
        value = last.split(":", 1)[1].strip() if ":" in last else ""
        if value[:1] in "\"'" and value[:1] and (len(value) < 2 or value[-1] != value[0]):
            return kind, "open quote", True, core_length, bare
        if ":" not in last and not last.lstrip().startswith("-"):
            return kind, "cut word", True, core_length, bare
        return kind, "", value[:1] in ('"', "'") and len(value) > 1, core_length, bare
    if kind == "markup":
        left = _open_markup(t.rstrip())
        return kind, f"open {left}" if left else "", t.rstrip().endswith(">"), core_length, bare
    if _open_in_prose(t):
        return kind, "open markup", True, core_length, bare
    last = t.rstrip().rsplit("\n", 1)[-1].strip()
    return kind, "", last.endswith((".", "!", "?", ")", '"', "|", "```", "-->", "</details>")) and not last.startswith("#") and not dots, core_length, bare


def text_of_bytes(raw: bytes) -> str:
    """Text of stored bytes; a multibyte sequence that the end cuts becomes U+FFFD.

    Bytes that are no UTF-8 elsewhere are read as Latin-1, so they prove nothing.
    """
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.reason == "unexpected end of data" and e.end == len(raw):
            return raw[: e.start].decode("utf-8") + "\ufffd"
        return raw.decode("latin-1")


SIGNS = "doc_id long, source string, n_chars long, core_length long, kind string, cut string, ends_usually boolean, bare boolean, text_hash long"


def signs_of_truncation(documents: DataFrame) -> DataFrame:
    """What the automaton says of every document with a text (whole texts, one pass).

    ``text`` may be a string or the stored bytes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [text_of_bytes(t) if isinstance(t, bytes) else t for t in b.column(2).to_pylist()]
            rows = [(*examine(t), len(t)) for t in texts]
            col = lambda i, kind: pa.array([r[i] for r in rows], kind)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), col(5, pa.int64()), col(3, pa.int64()), col(0, pa.string()), col(1, pa.string()), col(2, pa.bool_()), col(4, pa.bool_()), b.column(3)],
                names=["doc_id", "source", "n_chars", "core_length", "kind", "cut", "ends_usually", "bare", "text_hash"],
            )

    return documents.where("text is not null").select("doc_id", F.coalesce(source_name(F.col("source")), F.lit("")).alias("source"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, SIGNS)


def _baselines(signs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How texts usually end, full field lengths, and block sizes, by source."""
    whole = signs.where("cut = ''")
    n = whole.groupBy("source", "kind").agg(F.count("*").alias("n"), F.count_if("ends_usually").alias("n_usual"), F.count_if(~F.col("bare")).alias("l"), F.count_if(F.col("ends_usually") & ~F.col("bare")).alias("l_usual"))
    by_kind = n.groupBy("kind").agg(F.sum("n").alias("kn"), F.sum("n_usual").alias("kn_usual"))
    # A source that truncates much of a kind misses the share as one does whose texts really
    # end otherwise; all other sources tell them apart, whatever the source's own size. Where
    # they have too few texts, its texts that end in a line break, which cuts rarely do, tell.
    others, own = F.col("kn") - F.col("n"), F.col("n_usual") < USUAL * F.col("n")
    by_others = F.col("kn_usual") - F.col("n_usual") < USUAL * others
    by_lines = F.col("l_usual") < USUAL * F.col("l")
    endings = n.join(by_kind, "kind").select("source", "kind", (~(own & F.when(others >= LEAST_TEXTS, by_others).otherwise(by_lines))).alias("expects_ending"))
    # A field can have had several limits, and a mark can stand after what filled it: below
    # the greatest length, one counts if its bare texts stand out against all near it, more
    # clearly, as there are many lengths at which chance could do so.
    lengths = signs.where("core_length > 0").groupBy("source", "core_length").agg(F.count_distinct("text_hash").alias("n"), F.count_distinct(F.when(F.col("bare"), F.col("text_hash"))).alias("n_bare"))
    by_source = Window.partitionBy("source")
    near = by_source.orderBy("core_length").rangeBetween(-NEAR, NEAR)
    chance = (F.sum("n").over(near) - F.col("n")) / (2 * NEAR)
    least = F.greatest(F.lit(1.0), F.when(F.col("core_length") == F.max("core_length").over(by_source), 2 * chance).otherwise(FULL_RATIO * chance))
    full = lengths.withColumn("least", FULL_RATIO * least).where((F.col("n_bare") >= FULL_TEXTS) & (F.col("n_bare") >= F.col("least"))).select("source", F.col("core_length").alias("limit"))
    cut = signs.where("cut <> '' and bare")
    blocks = cut.groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(F.col("core_length") % b == 0).alias(f"b{b}") for b in BLOCKS])
    size = F.lit(None).cast("int")
    for b in BLOCKS:  # the smallest block that explains as much comes last and wins only if it explains more
        size = F.when((F.col(f"b{b}") >= BLOCK_TEXTS) & (F.col(f"b{b}") >= BLOCK_SHARE * F.col("n")) & (F.col(f"b{b}") > F.coalesce(*[F.when(F.col(f"b{x}") >= BLOCK_TEXTS, F.col(f"b{x}")) for x in BLOCKS if x > b], F.lit(0))), b).otherwise(size)
    blocks = blocks.select("source", size.alias("block")).where("block is not null")
    return tuple(broadcast_if_small(f) for f in (endings, full, blocks))


def judged_documents(documents: DataFrame) -> DataFrame:
    """Every document with a text: ``doc_id, source, kind, n_chars, reason, truncated``.

    ``reason`` is what the automaton found, or ``unusual end``, ``full field`` or ``end
    of a block`` where a baseline decides.  Empty and null texts aren't truncated: there
    is nothing that could go on.  A null source is a source of its own (empty name).
    """
    spark = documents.sparkSession
    path = shared_dir(spark, "truncation")
    signs_of_truncation(documents).write.parquet(path)
    signs = spark.read.parquet(path)
    endings, full, blocks = _baselines(signs)
    j = signs.join(endings, ["source", "kind"], "left").join(full.withColumnRenamed("limit", "core_length").withColumn("full", F.lit(True)), ["source", "core_length"], "left").join(blocks, "source", "left")
    reason = (
        F.when(F.col("kind") == "empty", "")
        .when(F.col("cut") != "", F.col("cut"))
        .when(~F.col("ends_usually") & F.coalesce("expects_ending", F.lit(True)), "unusual end")
        .when(F.col("bare") & F.col("full"), "full field")
        .when(F.col("bare") & (F.col("core_length") % F.col("block") == 0), "end of a block")
        .otherwise("")
    )
    return j.select("doc_id", "source", "kind", "n_chars", reason.alias("reason"), (reason != "").alias("truncated"))


def truncation_by_source(judged: DataFrame) -> DataFrame:
    """How often each source truncates."""
    return judged.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("truncated").alias("n_truncated"), F.avg(F.col("truncated").cast("double")).alias("share_truncated"))
