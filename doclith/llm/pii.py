"""Personal data: patterns of four kinds, and identifiers that the contexts of those lead to.

Base spans come from one regular expression a kind and a check. They are the seeds of a bootstrap: the words around
them are lexical patterns; other words with digits, an ``@`` or colons and runs of digits that single blanks join are
candidates, if they have a kind's shape and touch no base span. A pattern is as trustworthy for a kind as the share of
that kind's known instances among all instances seen in it; a candidate is as likely as its patterns together make it,
and one that passes becomes known for the next round, until a round adds none. Rounds are joins and sums over the graph
of patterns and instances. Base spans stay; of discovered spans one inside the other the longer one counts.

The expressions are written with possessive quantifiers and start only where a run starts, and they find what the plain
ones find. Places of matches, overlaps and what lies around a span come from running sums and maxima over arrays, each
in as many passes as its length has bits: a text of any length with n matches takes n log n steps. All of it is DataFrame
expressions. Spans are counted in code points.

Defined cases: null and empty texts have no spans; repeated texts have one text's spans; null ids pass through; bytes
that are no UTF-8 count as U+FFFD; a very long text is one row's work, its words are never cut; spans of two kinds may
have one place, and both count; columns of the input that have the name of a result are replaced; an empty table gives
an empty table.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclith.llm.shared import cut, keep
from doclith.llm.text import packed, whole

KINDS = ("email", "ip", "card", "phone")
#: The kinds' expressions as they are defined.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches.
LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"[^\x20\x09-\x0D]"
#: Words with a digit, an @ or four colons: all that can have a shape below.
CANDIDATE = rf"(?<!{WORD})(?:[^\x20\x09-\x0D0-9]*+[0-9]{WORD}*+|[^\x20\x09-\x0D@]*+@{WORD}*+|[^\x20\x09-\x0D:]*+(?::[^\x20\x09-\x0D:]*+){{4,}}+)"
#: Runs of digits, brackets, dots and hyphens between them, that single blanks join.
PIECE = r"\(?+[0-9]++(?:[().-]++[0-9]++)*+\)?+"
RUN = rf"(?<![0-9A-Za-z@_.(+-]){PIECE}(?:\x20{PIECE})++"
#: What a discovered instance of a kind can look like, blanks left out.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9]{1,3}(?:[.:,-][0-9]{1,3}){3}(?::[0-9]{1,5})?$|^[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){4,7}$",
    "card": r"^[0-9](?:[.-]?[0-9]){11,18}$",
    "phone": r"^(?:00|\(|[0-9])[0-9().-]{5,17}[0-9]$",
}
EDGES = ".,;:!?\"'()[]{}<>*#$%&|="
EDGE = "".join(f"\\x{ord(c):02x}" for c in EDGES)  # as a character class
SUPPORT = 3  # known instances that a pattern needs
TRUST = 0.8  # of a pattern that is used
ACCEPT = 0.95  # of a candidate
SPAN = "array<struct<start: int, kind: int, end: int>>"


def _luhn(digits: Column) -> Column:
    """Whether the digits pass: from the right every second one doubled, 9 taken off above 9, the sum a multiple of 10."""
    back = F.reverse(digits)
    value = lambda i: F.substring(back, i + 1, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    each = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.when(i % 2 == 1, twice(value(i))).otherwise(value(i)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]+", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).substr(1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _running(values: Column, join) -> Column:
    """The array's running join (an associative function), by passes that double how far each element has seen."""
    shift = lambda k: F.call_function("shiftleft", F.lit(1), k)
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(values))).cast("int") - 1, F.lit(0)))
    step = lambda seen, k: F.transform(seen, lambda x, i: F.when(i >= shift(k), join(F.get(seen, i - shift(k)), x)).otherwise(x))
    return F.aggregate(passes, values, step)


def _found(df: DataFrame, name: str, pattern: str, present: Column) -> DataFrame:
    """Adds three arrays to rows with _t: the matches, what lies between them (one more), and where they are: start, end, j, match."""
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    df = df.withColumns({f"{name}_f": F.when(present, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(none), f"{name}_b": F.when(present, F.split("_t", pattern, -1)).otherwise(none)})
    # Arrays are arguments here, not looked up inside: Spark may put an expression in the place of a column's name.
    ends = _running(F.zip_with(F.slice(f"{name}_b", 1, F.size(f"{name}_f")), f"{name}_f", lambda b, f: F.length(b) + F.length(f)), lambda x, y: x + y)
    both = F.zip_with(f"{name}_f", ends, lambda f, e: F.struct((e - F.length(f)).alias("start"), e.alias("end"), f.alias("match")))
    return df.withColumn(name, F.transform(both, lambda m, j: F.struct(m["start"].alias("start"), m["end"].alias("end"), j.alias("j"), m["match"].alias("match"))))


def _with_base(df: DataFrame) -> DataFrame:
    """Adds _base, the base spans (start, kind's number, end) in order, to rows with _t; _digits, if _t has any; and each
    kind's arrays."""
    df = df.withColumn("_digits", F.col("_t").rlike("[0-9]"))
    spans = []
    for number, kind in enumerate(KINDS):
        need = F.col("_t").contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
        df = _found(df, f"_{kind}", LINEAR[kind], need & (F.lit(True) if kind == "email" else F.col("_digits")))
        df = df.withColumn(f"_{kind}", F.filter(f"_{kind}", lambda m: _valid(kind, m["match"])))  # noqa: B023
        spans.append(F.transform(f"_{kind}", lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"))))  # noqa: B023
    return df.withColumn("_base", F.sort_array(F.concat(*spans)))


def _patterns(name: str, j: Column) -> Column:
    """The lexical patterns around a match: the words before it, the word after it, and both. What stands before it in
    its own word counts as a word, unless it is punctuation alone."""
    part = lambda what, i: F.coalesce(F.get(f"{name}_{what}", i), F.lit(""))
    back = F.reverse(F.lower(F.concat(part("f", j - 2), part("b", j - 1), part("f", j - 1), part("b", j))))
    back = F.regexp_replace(back, rf"^[{EDGE}]++(?![^\x20\x09-\x0D])", "")
    ahead = F.lower(F.concat(part("b", j + 1), part("f", j + 1), part("b", j + 2)))
    one = F.reverse(F.regexp_extract(back, rf"^[\x20\x09-\x0D]*+({WORD}++)", 1))
    two = F.reverse(F.regexp_extract(back, rf"^[\x20\x09-\x0D]*+({WORD}++[\x20\x09-\x0D]++{WORD}++)", 1))
    after = F.regexp_extract(ahead, rf"^{WORD}*+[\x20\x09-\x0D]++({WORD}++)", 1)
    every = F.array(F.concat(F.lit("<"), one), F.concat(F.lit("<<"), two), F.concat(F.lit("<"), one, F.lit(" >"), after))
    return F.array_distinct(F.filter(every, lambda p: ~p.isin("<", "<<", "< >")))


def _with_contexts(df: DataFrame) -> DataFrame:
    """Adds _seen to rows of :func:`_with_base`: (start, end, instance, kind or null, patterns) of base spans and candidates."""
    df = _found(df, "_word", CANDIDATE, F.col("_digits") | F.col("_t").contains("@") | F.col("_t").contains(":"))
    df = _found(df, "_run", RUN, F.col("_digits"))
    edge = lambda m: F.length(m["match"]) - F.length(F.ltrim(m["match"], F.lit(EDGES)))
    word = F.transform("_word", lambda m: F.struct((m["start"] + edge(m)).alias("start"), F.btrim(m["match"], F.lit(EDGES)).alias("instance"), m["j"].alias("j"), F.lit(1).alias("from")))
    run = F.transform("_run", lambda m: F.struct(m["start"].alias("start"), m["match"].alias("instance"), m["j"].alias("j"), F.lit(2).alias("from")))
    shaped = F.filter(F.concat(word, run), lambda m: _shape(F.lower(m["instance"])).isNotNull())
    span = lambda m, end, **rest: F.struct(m["start"].alias("start"), end.alias("end"), *(c.alias(n) for n, c in rest.items()))
    shaped = F.transform(shaped, lambda m: span(m, m["start"] + F.length(m["instance"]), **{"from": m["from"], "j": m["j"], "instance": m["instance"]}))
    base = F.transform("_base", lambda m: span(m, m["end"], **{"from": F.lit(0), "j": F.lit(0), "instance": F.lit("")}))
    df = df.withColumn("_shaped", shaped)
    df = df.withColumn("_all", F.when(F.size("_shaped") > 0, F.sort_array(F.concat("_shaped", base))).otherwise(F.col("_shaped")))
    own = lambda m, c, other: F.when(m["from"] == 0, m[c]).otherwise(other)
    upto = _running(F.transform("_all", lambda m: own(m, "end", 0)), lambda x, y: F.greatest(x, y))
    after = F.reverse(_running(F.reverse(F.transform("_all", lambda m: own(m, "start", (1 << 31) - 1))), lambda x, y: F.least(x, y)))
    # A candidate's own entry says nothing of base spans, so what has run up to it is what lies before and after it.
    bounds = F.zip_with(upto, after, lambda x, y: F.struct(x.alias("upto"), y.alias("after")))
    every = F.zip_with("_all", bounds, lambda m, o: F.when((m["from"] > 0) & (o["upto"] <= m["start"]) & (o["after"] >= m["end"]), m))
    df = df.withColumn("_free", F.filter(every, lambda m: m.isNotNull()))
    seen = lambda m, kind, patterns: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lower(m["instance" if kind is None else "match"]).alias("instance"), F.lit(kind).cast("int").alias("kind"), patterns.alias("patterns"))
    free = F.transform("_free", lambda m: seen(m, None, F.when(m["from"] == 1, _patterns("_word", m["j"])).otherwise(_patterns("_run", m["j"]))))
    known = [F.transform(f"_{kind}", lambda m: seen(m, number, _patterns(f"_{kind}", m["j"]))) for number, kind in enumerate(KINDS)]  # noqa: B023
    return df.withColumn("_seen", F.concat(*known, free))


def _shape(instance: Column) -> Column:
    """The number of the first kind whose shape the instance has, else null."""
    out = F.lit(None).cast("int")
    for number, kind in reversed(list(enumerate(KINDS))):
        out = F.when(F.replace(instance, F.lit(" "), F.lit("")).rlike(SHAPES[kind]), F.lit(number)).otherwise(out)
    return out


def _text(text: str) -> Column:
    return F.make_valid_utf8(whole(F.col(text)))


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, _k (the text's digest), _base, _seen: the one pass over the texts, kept."""
    rows = docs.select(F.col(key), _text(text).alias("_t"))
    rows = rows.withColumn("_k", F.md5(F.col("_t").cast("binary")))
    return keep(_with_contexts(_with_base(rows)).select(key, "_k", "_base", "_seen"), "pii-spans")


def _discovered(read: DataFrame, rounds: int | None) -> DataFrame:
    """_k, _added: the spans that the bootstrap adds to the texts with that digest. Known instances only become more and so
    do trusted patterns, so rounds end."""
    texts = read.where(F.size("_seen") > 0).dropDuplicates(["_k"])
    seen = texts.select("_k", F.explode("_seen").alias("m")).select("_k", "m.start", "m.end", "m.instance", F.coalesce("m.kind", _shape(F.col("m.instance"))).alias("kind"), F.col("m.kind").isNotNull().alias("base"), "m.patterns")
    seen = keep(seen, "pii-seen")
    graph = cut(seen.select("instance", "kind", "base", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance", "kind").agg(F.max("base").alias("base")))
    candidates = graph.where("NOT base").select("pattern", "instance", "kind")
    known = None
    for _ in itertools.count() if rounds is None else range(rounds):
        at = graph if known is None else graph.join(known.withColumn("_new", F.lit(True)), ["instance", "kind"], "left").withColumn("base", F.col("base") | F.coalesce("_new", F.lit(False)))
        by_kind = at.groupBy("pattern", "kind").agg(F.sum(F.col("base").cast("long")).alias("n"), F.count(F.lit(1)).alias("m"))
        every = by_kind.groupBy("pattern").agg(F.sum("m").alias("all"))
        trust = by_kind.where(F.col("n") >= SUPPORT).join(every, "pattern").select("pattern", "kind", (F.col("n") / (F.col("all") + 0.1)).alias("trust")).where(F.col("trust") >= TRUST)
        doubt = candidates.join(trust, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.sum(F.log1p(-F.least("trust", F.lit(0.999)))).alias("_d"))
        now = cut(doubt.where(1 - F.exp("_d") >= ACCEPT).select("instance", "kind"))
        if now.isEmpty() or (known is not None and now.join(known, ["instance", "kind"], "left_anti").isEmpty()):
            known = now if known is None else known
            break
        known = now if known is None else cut(known.union(now).distinct())
    known = candidates.select("instance", "kind").where("false") if known is None else known
    spans = seen.where("NOT base").join(known, ["instance", "kind"]).select("_k", F.struct("start", "kind", "end").alias("s"))
    # Earlier starts come first and, of one start, later ends: a span lies in a longer one if an end before it is later
    # than its own, or is its own and started earlier.
    reach = lambda s: F.struct(s["end"].alias("end"), (-s["start"]).alias("back"))
    found = spans.select("_k", F.struct(F.col("s.start"), (-F.col("s.end")).alias("back"), F.col("s.end"), F.col("s.kind")).alias("s")).groupBy("_k").agg(F.sort_array(F.collect_set("s")).alias("_s"))
    most = _running(F.transform("_s", reach), lambda x, y: F.greatest(x, y))
    outer = F.filter(F.zip_with("_s", most, lambda s, m: F.when(m <= reach(s), s)), lambda s: s.isNotNull())
    return found.select("_k", F.transform(outer, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("_added"))


def _named(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _none() -> Column:
    return F.expr(f"CAST(array() AS {SPAN})")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_discovered of every document."""
    read = _read(docs, key, text)
    joined = read.join(_discovered(read, rounds), "_k", "left").withColumn("_added", F.coalesce("_added", _none()))
    counts = {f"n_{kind}": F.size(F.filter("_base", lambda s: s["kind"] == number)).cast("long") for number, kind in enumerate(KINDS)}  # noqa: B023
    return joined.select(
        F.col(key), *(c.alias(n) for n, c in counts.items()), F.sha2(_named(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _named(F.sort_array(F.concat("_base", "_added"))).alias("spans"), F.size("_added").cast("long").alias("n_discovered"),
    )


def redact(docs: DataFrame, text: str = "text", rounds: int | None = None) -> DataFrame:
    """The input with each span replaced by its kind in brackets; where spans overlap, by that of the one that starts first."""
    read = _read(docs.select(F.lit(0).alias("_key"), F.col(text).alias("_text")), "_key", "_text")
    added = keep(_discovered(read, rounds), "pii-added")
    rows = docs.select(packed(docs), _text(text).alias("_t")).withColumn("_k", F.md5(F.col("_t").cast("binary")))
    rows = _with_base(rows).select("own", "_t", "_k", "_base").join(added.select("_k", "_added"), "_k", "left")
    rows = rows.withColumn("_spans", F.sort_array(F.concat("_base", F.coalesce("_added", _none()))))
    # Four bytes a code point: a piece is found without counting from the text's start.
    rows = rows.withColumn("_wide", F.when(F.size("_spans") > 0, F.encode("_t", "UTF-32")))
    ends = F.concat(F.array(F.lit(0)), _running(F.transform("_spans", lambda s: s["end"]), lambda x, y: F.greatest(x, y)))
    rows = rows.withColumn("_ends", ends)
    piece = lambda a, b: F.decode(F.substring("_wide", 4 * a + 1, 4 * (b - a)), "UTF-32")
    label = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    one = lambda s, before: F.when(s.isNull(), piece(before, F.length("_t"))).when(s["start"] >= before, F.concat(piece(before, s["start"]), F.get(label, s["kind"]))).otherwise("")
    masked = F.array_join(F.zip_with("_spans", "_ends", one), "")  # one end more than spans: the rest of the text
    return rows.select(F.col("own").withField(f"`{text}`", F.when(F.size("_spans") > 0, masked).otherwise(F.col("own")[text])).alias("own")).select("own.*")
