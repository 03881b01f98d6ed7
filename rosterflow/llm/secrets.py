"""Secret scans in DataFrame operations: three patterns, and a sliding window of Shannon entropy over candidate strings.

A candidate is a run of characters that keys are made of. Going along it, the window's character counts, and the sum of c*log2(c) over
them, are brought up to date for the character that enters and the one that leaves. A window whose entropy reaches its character
class's threshold makes the run a finding, unless it is on the allow list, is made of words, or overlaps a finding of a pattern. A run
of digits and separators alone is never an entropy finding; 16 digits in a row are one of the pattern hex. Offsets are code points,
the end exclusive. A null text is the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns. A match fails if what the pattern's group holds is shorter than the number.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
PATTERNS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
#: Not secrets, whatever their entropy, each for a whole run: UUIDs, numbers, rows of the alphabet, of digits and of keys,
#: and keys of manuals, which end in EXAMPLE or EXAMPLEKEY or open with a placeholder.
ALLOW = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", r"[0-9/_=+-]+", r"(?i)(abcdefghijklmnopqrstuvwxyz|0123456789|1234567890|qwertyuiop|asdfghjkl|zxcvbnm|[/_=+-]){1,16}",
    r"[A-Za-z0-9/+]{0,64}EXAMPLE(KEY)?", r"(?i)(example|placeholder|changeme|x{6,})[/_=+-].*",
)
#: Character classes with their thresholds in bits, the first that fits: about 1 % of random keys of 20 characters stay below. Hex and
#: what fits none (mixed case or base64 with digits) have parameters of their own.
CLASSES = ((r"[a-z/_=+-]+|[A-Z/_=+-]+", 3.2), (r"[a-z0-9/_=+-]+|[A-Z0-9/_=+-]+", 3.35), (r"[A-Za-z/_=+-]+", 3.5))
#: Common pairs of letters in English, German, French and Spanish. Words are mostly made of them, random letters are not.
PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai "
    "sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp ab gh ty op sa ay ex fr ag if ap do bl qu ue ei sc hn eb ah eu au tz zu ft ht ux em cr gr rc rd ke up ep"
)
WORDLIKE = 0.5
SPAN = "array<struct<start:int,kind:int,end:int>>"
SEGMENT = 256
#: Folds that lengthen an array copy what they have at each step, so they go over this many entries at a time.
CHUNK = 64
#: A long text is cut into pieces of so many characters, in which a place is found without going through the text from its start.
PIECE = 4096


def let(name: str, value: str, body: str) -> str:
    """SQL: body with a value worked out once, under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def in_chunks(array: str, total: str, zero: str, start: str, step: str, done: str) -> str:
    """SQL: the joined results of a fold over each chunk of an array. total: a chunk's own amount, from its entries (``c``), of type of zero;
    start: the fold's state, from ``at``, what all chunks before came to by ``total`` (a sum, or the largest, by ``a`` and ``x``)."""
    chunks = f"transform(sequence(0, (size({array}) - 1) div {CHUNK}), k -> slice({array}, cast(k * {CHUNK} + 1 as int), {CHUNK}))"
    before = f"aggregate(transform(cs, c -> {total}), named_struct('at', {zero}, 'out', array_remove(array({zero}), {zero})), (a, x) -> named_struct('at', {step}, 'out', array_append(a.out, a.at)), a -> a.out)"
    each = f"flatten(transform(cs, (c, k) -> {let('at', 'bs[k]', start.replace('{fold}', done))}))"
    return f"if(size({array}) = 0, array(), {let('cs', chunks, let('bs', before, each))})"


def find_spans(pattern: str, group: int, least: int, rank: int, text: bool = False) -> Column:
    """Spans of a pattern in ``text``, with the matches' texts (s) where asked for: the pieces between matches and the matches give each
    one's place by their lengths, summed chunk by chunk."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    kind = SPAN.replace("end:int", "end:int,s:string") if text else SPAN
    parts = f"arrays_zip(split(text, '{p}', -1), regexp_extract_all(text, '{p}', 0), regexp_extract_all(text, '{p}', {group}))"
    held = ", 's', x.`1`" if text else ""
    fold = f"""aggregate(c, named_struct('at', at, 'out', cast(array() as {kind})),
        (s, x) -> named_struct('at', s.at + length(x.`0`) + coalesce(length(x.`1`), 0),
            'out', if(length(x.`2`) >= {least}, array_append(s.out, named_struct('start', s.at + length(x.`0`), 'kind', {rank}, 'end', s.at + length(x.`0`) + length(x.`1`){held})), s.out)),
        s -> s.out)"""
    total = "aggregate(c, 0, (a, x) -> a + length(x.`0`) + coalesce(length(x.`1`), 0))"
    spans = let("zs", parts, in_chunks("zs", total, "0", "{fold}", "a.at + x", fold))
    return F.expr(f"cast(if(text rlike '{p}', {spans}, array()) as {kind})")


def overlaps(spans: str, r: str) -> str:
    """SQL: does r overlap one of the spans? They are in order and apart, so halving finds the last that begins before r ends."""
    middle = "cast((a.lo + a.hi) div 2 as int)"
    at = f"aggregate(sequence(1, 32), named_struct('lo', 0, 'hi', size({spans})), (a, k) -> if(a.lo >= a.hi, a, if({spans}[{middle}].start < {r}.end, named_struct('lo', {middle} + 1, 'hi', a.hi), named_struct('lo', a.lo, 'hi', {middle}))), a -> a.lo)"
    return f"(size({spans}) > 0 and {let('i', at, f'i > 0 and {spans}[greatest(i - 1, 0)].end > {r}.start')})"


def window_entropy(window: int) -> str:
    """SQL for the largest entropy of any window of an ASCII string ``s``, or 0 for a shorter one. The state holds the window's counts by
    character code and their sum of c*log2(c); a step changes both by the character that enters (e) and the one that leaves (l)."""
    grown = "(({c} + 1) * log2({c} + 1) - if({c} > 0, {c} * log2({c}), 0D))"
    change = f"if(p.e = p.l, 0D, {grown.format(c='a.n[p.e]')} - if(p.l < 0, 0D, {grown.format(c='(a.n[p.l] - 1)')}))"
    return f"""aggregate(
        transform(sequence(1, length(s)), i -> named_struct('i', i, 'e', ascii(substring(s, i, 1)), 'l', if(i > {window}, ascii(substring(s, i - {window}, 1)), -1))),
        named_struct('n', array_repeat(0, 128), 'sum', 0D, 'best', 0D),
        (a, p) -> named_struct(
            'n', if(p.e = p.l, a.n, transform(a.n, (c, k) -> c + if(k = p.e, 1, 0) - if(k = p.l, 1, 0))),
            'sum', a.sum + {change},
            'best', if(p.i >= {window}, greatest(a.best, log2({window}) - (a.sum + {change}) / {window}), a.best)),
        a -> a.best)"""


def wordlike(s: str) -> str:
    """SQL: is the run s made of words and numbers? Common pairs must hold their share of its letter pairs, and of those of each 20
    characters along it, so that words do not hide a key beside them. Single letters between digits make no word."""
    share = "(regexp_count(lower({x}), '(?=" + "|".join(dict.fromkeys(PAIRS.split())) + ")') >= {least} * regexp_count({x}, '(?=[A-Za-z]{{2}})'))"
    pieces = f"transform(sequence(1, greatest(1, length({s}) - 19), 10), k -> substring({s}, k, if(k + 29 > length({s}), 30, 20)))"
    return f"(not {s} rlike '[0-9]{{9,}}|[0-9][A-Za-z][0-9]' and {share.format(x=s, least=WORDLIKE)} and regexp_count({s}, '(?=[A-Za-z]{{2}})') >= 8 and forall({pieces}, p -> {share.format(x='p', least=WORDLIKE - 0.1)}))"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, hex_bits: float = 3.0, mixed_bits: float = 3.65, classes: tuple[tuple[str, float], ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Every row of docs in ``row``, with id, text, base (spans of the patterns) and spans (those and the entropy findings), by start, then
    kind, then end. Empty texts and tables have none. Repeated rows are scanned once each; texts are scanned whole, whatever their length.
    Extra columns do not matter, whatever their names."""
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumns({f"s{k}": find_spans(p, group, least, k) for k, (_, p, group, least) in enumerate(PATTERNS)})
    d = d.withColumn("base", F.array_sort(F.concat("s0", "s1", "s2")))
    d = d.withColumn("runs", find_spans(CANDIDATE, 0, 20, len(PATTERNS), text=True))
    apart = " or ".join(overlaps(f"s{k}", "r") for k in range(len(PATTERNS)))
    d = d.withColumn("runs", F.expr(f"filter(runs, r -> not ({apart}) and " + " and ".join(["true", *(f"not r.s rlike '^(?:{a})$'".replace("\\", "\\\\") for a in allow)]) + ")")).drop("s0", "s1", "s2")
    # long runs are gone along in overlapping segments, so that no step looks through a long string
    parts = f"transform(sequence(0, (length(r.s) - 1) div {SEGMENT}), k -> substring(r.s, k * {SEGMENT} + 1, {SEGMENT + window - 1}))"
    best = f"array_max(transform({parts}, s -> {window_entropy(window)}))"
    least = f"case when r.s rlike '^[0-9a-fA-F]+$' then {float(hex_bits)}D " + "".join(f"when r.s rlike '^(?:{c})$' then {float(bits)}D " for c, bits in classes) + f"else {float(mixed_bits)}D end"
    d = d.withColumn("added", F.expr(f"transform(filter(runs, r -> {best} >= {least} and not {wordlike('r.s')}), r -> named_struct('start', r.start, 'kind', r.kind, 'end', r.end))"))
    return d.withColumn("spans", F.array_sort(F.concat("base", "added"))).drop("runs", "added")


def joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k[0]}'" for k in PATTERNS) + ", 'entropy')"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: counts of the patterns' spans, their digest, and all spans as text."""
    d = scan_secrets(docs, id_col, text_col, **options)
    return d.select(
        F.col("id").alias(id_col),
        *[F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint)").alias(f"n_{name}") for k, (name, *_) in enumerate(PATTERNS)],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", length_col: str = "n_chars", **options) -> DataFrame:
    """docs with every span replaced by ``mask``; overlapping spans count as one. Rows without a span are unchanged."""
    d = scan_secrets(docs, id_col, text_col, **options)
    safe = mask.replace("'", "\\'")
    # what stands between the end of all spans before and a span's start, from the pieces of the text that hold it
    first, last = f"cast({{a}} div {PIECE} as int)", f"cast({{b}} div {PIECE} as int)"
    part = f"substring(array_join(slice(ps, {first} + 1, {last} - {first} + 1), ''), {{a}} % {PIECE} + 1, {{b}} - {{a}})"
    between = part.replace("{a}", "s.at").replace("{b}", "x.start")
    fold = f"""aggregate(c, named_struct('at', at, 'out', cast(array() as array<string>)),
        (s, x) -> named_struct('at', greatest(s.at, x.end), 'out', if(x.start < s.at, s.out, array_append(s.out, concat({between}, '{safe}')))), s -> s.out)"""
    masked = in_chunks("spans", "aggregate(c, 0, (a, x) -> greatest(a, x.end))", "0", "{fold}", "greatest(a.at, x)", fold)
    end = "aggregate(spans, 0, (a, x) -> greatest(a, x.end))"
    text = F.expr(let("ps", f"regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0)", f"concat(array_join({masked}, ''), substring(text, {end} + 1, length(text)))"))
    d = d.withColumn("clean", F.when(F.size("spans") == 0, F.col(f"row.`{text_col}`")).otherwise(text))
    fixed = {text_col: F.col("clean")}
    if length_col in docs.columns:
        fixed[length_col] = F.when(F.size("spans") == 0, F.col(f"row.`{length_col}`")).otherwise(F.length("clean")).cast(docs.schema[length_col].dataType)
    return d.select(*[fixed[c].alias(c) if c in fixed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
