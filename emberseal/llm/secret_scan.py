"""Secret scans by fixed patterns and by sliding-window entropy.

Native: patterns run in Spark's own regular expressions. Positions come from
the lengths of the pieces between matches (split) and of the matches
(regexp_extract_all), summed in one fold per kind, which works through CHUNK
matches at a time so that its lists stay short. For entropy, candidate
strings are runs of 20 or more characters of [A-Za-z0-9+/_=-]. Each gets the
narrowest character class that holds it; a fold moves a window over it,
raising the count of the character that enters, lowering that of the one that
leaves and adjusting the sum of c * log2(c) by these two terms. Letters alone
are no reason to pass a candidate over, only forms that words have are. A candidate
whose highest window entropy reaches its class's threshold is reported, unless
an allow-list pattern matches it or it overlaps a span already found.

Nothing is shuffled: each row's result follows from its own text.

Edge cases: a null text is empty and has no spans; positions count code
points; a long text is scanned whole, in time that grows with its length;
every row comes back, equal ones too, with its doc_id as it is; other
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three base patterns, their least lengths and their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
_WORD = "[A-Z]?[a-z]++|[A-Z]++"
CHUNK = 256
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"


@dataclass(frozen=True)
class EntropyRules:
    """window: characters. classes: (pattern of the whole string, bits), the first that holds counts."""

    window: int = 20
    classes: tuple[tuple[str, float], ...] = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z0-9]+$", 3.7), ("", 3.9))
    #: Words (of one case or capitalised) and short numbers joined by signs, which covers paths; words written together,
    #: each with a capital; digits and signs alone; UUIDs; documented example keys. Loops are possessive, so none tries a start twice.
    allow: tuple[str, ...] = field(
        default=(
            f"^[+/_=-]*+(?:{_WORD})?(?:[+/_=-]++(?:{_WORD}|[0-9]{{1,4}}+))*+[+/_=-]*+$",
            "^[a-z]*+(?:[A-Z][a-z]{2,}+)++$",
            "^[0-9+/_=-]++$",
            "^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
            "^(?=.{20,80}$).*(?i:example|sample|placeholder|changeme|xxxx)",
        )
    )


def _matches(text: Column, pattern: str, least: int, group: int = 0, good=None) -> Column:
    """array<struct<gap, n, ok>>: text before each match, its length, and whether `group` has `least` characters and passes good(); the rest has no n."""
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    ok = lambda x: (F.length(x) >= least) & (F.lit(True) if good is None else good(x))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(gaps, F.transform(found(0), F.length), lambda gap, n: F.struct(gap.alias("gap"), n.alias("n")))
    return F.zip_with(pairs, F.transform(found(group), ok), lambda p, x: F.struct(p["gap"].alias("gap"), p["n"].alias("n"), x.alias("ok")))


def _spans(matches: Column) -> Column:
    """array<struct<a, z>> of the matches that are ok; `matches` is a plain column, since it is named for every chunk."""
    empty = F.array().cast("array<struct<a:int,z:int>>")
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + x["gap"]
        z = a + F.coalesce(x["n"], F.lit(0))
        return state(z, F.when(x["ok"], F.array_append(s["out"], F.struct(a.alias("a"), z.alias("z")))).otherwise(s["out"]))

    def chunk(s: Column, i: Column) -> Column:
        return F.aggregate(F.slice(matches, i * CHUNK + 1, CHUNK), state(s["at"], empty), step, lambda own: state(own["at"], F.concat(s["out"], own["out"])))

    chunks = F.sequence(F.lit(0), F.floor(F.size(matches) / CHUNK).cast("int"))
    return F.aggregate(chunks, state(F.lit(0), empty), chunk, lambda s: s["out"])


def _with_spans(rows: DataFrame, name: str, hint: str, matches: Column) -> DataFrame:
    """rows with the spans as column `name`; texts without the hint have none. The generator keeps the matches as a column."""
    none = F.array().cast("array<struct<gap:int,n:int,ok:boolean>>")
    held = rows.withColumn("_m", F.explode(F.array(F.when(F.col("text").rlike(hint), matches).otherwise(none))))
    return held.withColumn(name, _spans(F.col("_m"))).drop("_m")


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def window_entropy(text: Column, window: int) -> Column:
    """Highest Shannon entropy, in bits, of any `window` characters of ALPHABET in text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.zip_with(codes, F.concat(F.array_repeat(F.lit(-1), window), codes), lambda a, b: F.struct(a.alias("new"), b.alias("old")))
    start = F.struct(F.lit(0).alias("n"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        still = new.isNull() | (new == old)
        up = F.get(s["counts"], new)
        down = F.when(old >= 0, F.get(s["counts"], old))
        sum_ = F.when(still, s["sum"]).otherwise(s["sum"] + _clog(up + 1) - _clog(up) + F.coalesce(_clog(down - 1) - _clog(down), F.lit(0.0)))
        counts = F.when(still, s["counts"]).otherwise(F.transform(s["counts"], lambda c, j: c + (j == new).cast("int") - (j == old).cast("int")))
        bits = F.log2(F.lit(float(window))) - sum_ / window
        full = new.isNotNull() & (s["n"] + 1 >= window)
        return F.struct((s["n"] + 1).alias("n"), counts.alias("counts"), sum_.alias("sum"), F.when(full, F.greatest(s["best"], bits)).otherwise(s["best"]).alias("best"))

    return F.aggregate(steps, start, step, lambda s: s["best"])


def _surprising(rules: EntropyRules):
    """Whether a candidate is over its class's threshold and not allow-listed."""

    def over(c: Column) -> Column:
        bits = F.lit(rules.classes[-1][1])
        for pattern, least in reversed(rules.classes[:-1]):
            bits = F.when(c.rlike(pattern), F.lit(least)).otherwise(bits)
        allowed = c.rlike(f"^{HEX}+$")  # a base span already
        for pattern in rules.allow:
            allowed = allowed | c.rlike(pattern)
        return F.when(allowed, F.lit(False)).otherwise(window_entropy(c, rules.window) >= bits)

    return over


def secret_scan(docs: DataFrame, rules: EntropyRules | None = None) -> DataFrame:
    """doc_id, text, and for each kind an array of spans (a: start, z: end)."""
    rules = rules or EntropyRules()
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = _with_spans(rows, "assign", ASSIGN_HINT, _matches(text, ASSIGN, 6, 2))
    rows = _with_spans(rows, "access", ACCESS, _matches(text, ACCESS, 20))
    rows = _with_spans(rows, "hex", HEX, _matches(text, HEX, 24))
    rows = _with_spans(rows, "entropy", CANDIDATE, _matches(text, CANDIDATE, 0, good=_surprising(rules)))
    # Spans that overlap one already found are left out; most texts have none of either.
    base = F.concat("assign", "access", "hex")
    fresh = F.filter("entropy", lambda s: ~F.exists(base, lambda b: (b["a"] < s["z"]) & (b["z"] > s["a"])))
    return rows.withColumn("entropy", F.when((F.size("entropy") > 0) & (F.size(base) > 0), fresh).otherwise(F.col("entropy")))


def span_list(*kinds: str) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    one = lambda k: F.transform(F.col(k), lambda s: F.struct(s["a"].alias("a"), F.lit(KINDS.index(k)).alias("k"), s["z"].alias("z")))
    ordered = F.array_sort(F.concat(*map(one, kinds)))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["k"]], s["a"].cast("string"), s["z"].cast("string"))), ",")
