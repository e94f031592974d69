"""PII by bootstrapped contextual extraction, in DataFrame and SQL functions only.

1. Base spans: four fixed patterns (email, ip, card, phone), leftmost and non-overlapping
   per kind, with the checks of each kind; a match that fails its check is dropped.
2. Instances are the base values and the identifier-like words (they hold a digit or an @)
   that touch no base span. Seeds are the base values and, as a fifth kind, `secret`: words
   of 32 hexadecimal digits or more, letters and digits among them. The rest is unknown.
3. The surroundings of an instance induce lexical patterns: the word before it, the two
   words before it, the word before it with the word after it (lower case, digits as 0; of
   words over 64 characters the nearer 64), and its own form (digits as 0; with letters,
   runs of either as one character).
4. Over the bipartite pattern-instance graph of different values scores are computed in
   turns: conf(p) = (known values + messages of the unknown ones) / (values + 1), where the
   message of a value to a pattern is 1 - prod(1 - conf) over its other patterns, so that no
   pattern speaks for itself.
5. Patterns are trusted with min_support known values of one kind, which must be 0.8 of all
   its known ones, and conf >= min_conf; forms, which are not ambiguous but less telling,
   with ten and 0.4. Unknown values in their slots are known from then on, with that kind, and
   the next round starts; it ends when a round finds nothing new, or after `rounds`.
   Occurrences in trusted slots, and the secrets, become spans.

Null texts count as empty; a text without spans has zero counts and empty strings.
Repeated rows and copies get equal results; copies count once in the graph. Ties go to the
first kind. Spans are in code points, end exclusive. Extra columns are ignored. Texts are
read whole: the patterns are linear in the text (runs are entered only at their start or
where the last match ended). Work grows with the square of the number of spans of one
single text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import Workspace, content_key, packed, unpacked

#: The four kinds in order, with their patterns (possessive; entered at a run's start or at the end of the last match).
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap necessary conditions of the kinds.
HINTS = {"email": "text like '%@%'", "ip": r"text rlike '[0-9]\\.[0-9]'", "card": "text rlike '[0-9][ -]?[0-9]'", "phone": "text like '%+%'"}
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*?[0-9@][^\x20\x09-\x0D]*+"
NAMES = list(KINDS)
#: The kinds of seeds in order: the base ones, then those that only the graph has.
SEEDS = [*NAMES, "secret"]
SECRET = "^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"
#: A word's core: without quotes and punctuation around it.
OPEN, CLOSE = r"^[\"'(<\[{]*+", r"[\"')>\]},.;:!?%#*&$|~]++$"
#: Forms are trusted from so many known values and this confidence.
FORM_SUPPORT, FORM_CONF = 10, 0.4
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string,left:string,right:string>"


def _valid(kind: str, h: Column) -> Column:
    digits = F.regexp_replace(h, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(h, r"\."), lambda x: F.lpad(F.substring(F.ltrim(x, F.lit("0")), 1, 4), 4, "0") <= "0255")
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _tidy(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[0-9]", "0")


def _prefix(lens: Column, block: int = 256) -> Column:
    """Sums of all earlier elements, in blocks so that the work stays near linear."""
    empty = F.expr("cast(array() as array<bigint>)")

    def running(xs, start):
        step = lambda acc, x: F.struct((acc["tot"] + x).alias("tot"), F.concat(acc["out"], F.array(acc["tot"])).alias("out"))
        return F.aggregate(xs, F.struct(start.alias("tot"), empty.alias("out")), step, lambda acc: acc["out"])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / block).cast("int")), lambda b: F.slice(lens, b * block + 1, block))
    zero = F.lit(0).cast("long")
    sums = F.transform(parts, lambda xs: F.aggregate(xs, zero, lambda a, x: a + x))
    out = F.flatten(F.zip_with(parts, running(sums, zero), lambda xs, o: running(xs, o)))
    return F.when(F.size(lens) > 0, out).otherwise(empty)


def with_spans(d: DataFrame, words: bool = True) -> DataFrame:
    """d (text not null) with base, the base spans by start and kind, and words, the identifier-like words: array<SPAN>.

    The pieces between the matches give the places: a projection each for pieces and
    matches, for their running lengths and for the spans, so that nothing is computed twice.
    """
    todo = [(f"__{k}", KINDS[k], HINTS[k]) for k in NAMES] + ([("__w", WORD, "text rlike '[0-9@]'")] if words else [])
    rest = [c for c in d.columns]
    cut = d.select(*rest, *(F.when(F.expr(h), F.split("text", p, -1)).alias(f"{n}p") for n, p, h in todo), *(F.when(F.expr(h), F.regexp_extract_all("text", F.lit(p), 0)).alias(f"{n}h") for n, p, h in todo))
    lens = cut.select("*", *(F.transform(F.col(f"{n}h"), lambda h, i: F.char_length(F.get(F.col(f"{n}p"), i)).cast("long") + F.char_length(h)).alias(f"{n}l") for n, _, _ in todo))
    runs = lens.select("*", *(_prefix(F.col(f"{n}l")).alias(f"{n}r") for n, _, _ in todo))
    found = runs.select(*rest, *(F.coalesce(_spans(n, i if i < len(NAMES) else -1), F.expr(f"cast(array() as array<{SPAN}>)")).alias(n) for i, (n, _, _) in enumerate(todo)))
    base = F.array_sort(F.concat(*(_checked(k) for k in NAMES))).alias("base")
    return found.select(*rest, base, *([F.col("__w").alias("words")] if words else []))


def _spans(n: str, code: int) -> Column:
    def one(h, i):
        # the text around, over neighbouring matches: two matches and the pieces between hold two words at least
        piece = lambda k: F.coalesce(F.get(F.col(f"{n}p"), i + k), F.lit(""))
        hit = lambda k: F.coalesce(F.get(F.col(f"{n}h"), i + k), F.lit(""))
        start = F.get(F.col(f"{n}r"), i) + F.char_length(piece(0))
        tail, head = (lambda c: F.right(c, F.lit(130))), (lambda c: F.left(c, F.lit(130)))
        before = tail(F.concat(tail(piece(-2)), tail(hit(-2)), tail(piece(-1)), tail(hit(-1)), tail(piece(0))))
        after = head(F.concat(head(piece(1)), head(hit(1)), head(piece(2)), head(hit(2)), head(piece(3))))
        left = _tidy(F.regexp_extract(before, r"(\S{1,64}(?:\s+\S{1,64})?)(?:\s+\S{0,8})?$", 1) if code >= 0 else F.regexp_extract(before, r"(\S{1,64}(?:\s+\S{1,64})?)\s*$", 1))
        right = _tidy(F.regexp_extract(after, r"^\S*\s+(\S{1,64})", 1))
        end = F.get(F.col(f"{n}r"), i) + F.get(F.col(f"{n}l"), i)
        return F.struct(start.alias("start"), F.lit(code).alias("kind"), end.alias("end"), h.alias("value"), left.alias("left"), right.alias("right")).cast(SPAN)

    return F.transform(F.col(f"{n}h"), one)


def _checked(kind: str) -> Column:
    return F.filter(F.col(f"__{kind}"), lambda s: _valid(kind, s["value"]))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One pass over the texts: keep (a struct of the kept columns), key, base spans and identifier-like words."""
    d = docs.select(packed(keep).alias("keep"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return with_spans(d.withColumn("key", content_key())).select("keep", "key", "base", "words")


def _form(value: Column) -> Column:
    """The form of a value: digits as 0; with letters, runs of either as one character."""
    runs = F.regexp_replace(F.regexp_replace(value, "[0-9]+", "0"), r"\pL+", "a")
    return F.when(value.rlike(r"\pL"), runs).otherwise(F.regexp_replace(value, "[0-9]", "0"))


def occurrences(scanned: DataFrame) -> DataFrame:
    """Instances in their slots: key, kind (-1: unknown), start, value, pattern."""
    from pyspark.sql import Window as W

    one = scanned.where("size(base) + size(words) > 0").groupBy("key").agg(F.first("base").alias("base"), F.first("words").alias("words"))
    rows = one.select("key", F.explode(F.concat("base", "words")).alias("s")).select("key", "s.*")
    by = W.partitionBy("key").orderBy("start", F.desc("kind"))
    before = F.max(F.when(F.col("kind") >= 0, F.col("end"))).over(by.rowsBetween(W.unboundedPreceding, -1))
    back = W.partitionBy("key").orderBy(F.desc("start"), "kind")  # a frame that ends at the last row would be computed anew for each row
    after = F.min(F.when(F.col("kind") >= 0, F.col("start"))).over(back.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"before": before, "after": after})
    rows = rows.where("kind >= 0 or (coalesce(before, 0) <= start and coalesce(after, end) >= end)")
    lead = F.char_length(F.regexp_extract("value", OPEN, 0))
    core = F.regexp_replace(F.regexp_replace("value", OPEN, ""), CLOSE, "")
    word = F.col("kind") < 0
    rows = rows.select("key", "kind", F.when(word, F.col("start") + lead).otherwise(F.col("start")).alias("start"), F.when(word, core).otherwise(F.col("value")).alias("value"), "left", "right")
    rows = rows.where("value <> ''").withColumn("kind", F.when((F.col("kind") < 0) & F.col("value").rlike(SECRET), len(NAMES)).otherwise(F.col("kind")))
    first = F.regexp_extract("left", r"(\S+)$", 1)
    slots = F.array(
        F.concat(F.lit("f "), _form(F.col("value"))),
        F.when(first != "", F.concat(F.lit("w "), first)),
        F.when(F.col("left").rlike(r"\S\s+\S"), F.concat(F.lit("l "), F.regexp_replace("left", r"\s+", " "))),
        F.when((first != "") & (F.col("right") != ""), F.concat(F.lit("m "), first, F.lit(" "), "right")),
    )
    return rows.select("key", "kind", "start", "value", F.explode(F.array_compact(slots)).alias("pattern"))


def confidence(ws: Workspace, edges: DataFrame, tag: str, turns: int = 2) -> DataFrame:
    """pattern, conf, support and of (its known values of the commonest kind), pure (their share): for patterns with a known value."""
    each = [F.sum((F.col("kind") == k).cast("long")) for k in range(len(SEEDS))]
    base = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.array(*each).alias("by"))
    base = base.select("pattern", "n", F.array_max("by").alias("support"), (F.array_position("by", F.array_max("by")) - 1).cast("int").alias("of"), F.aggregate("by", F.lit(0).cast("long"), lambda a, x: a + x).alias("known"))
    base = ws.put(base.where("known > 0"), f"{tag}base")
    conf = base.select("pattern", (F.col("known") / (F.col("n") + 1)).alias("conf"))
    unknown = edges.where("kind < 0").select("pattern", "value")
    for t in range(turns):
        sent = ws.put(unknown.join(conf, "pattern").select("pattern", "value", F.log1p(-F.least("conf", F.lit(0.999))).alias("l")), f"{tag}sent{t}")
        total = ws.put(sent.groupBy("value").agg(F.sum("l").alias("all")), f"{tag}total{t}")
        extra = ws.put(sent.join(total, "value").groupBy("pattern").agg(F.sum(1 - F.exp(F.col("all") - F.col("l"))).alias("extra")), f"{tag}extra{t}")
        conf = ws.put(base.join(extra, "pattern", "left").select("pattern", ((F.col("known") + F.coalesce("extra", F.lit(0.0))) / (F.col("n") + 1)).alias("conf")), f"{tag}conf{t}")
    return base.join(conf, "pattern").select("pattern", "conf", "support", "of", (F.col("support") / F.col("known")).alias("pure"))


def discover(ws: Workspace, scanned: DataFrame, rounds: int = 5, min_conf: float = 0.8, min_support: int = 3) -> DataFrame:
    """Spans that the secrets and the trusted patterns add: (key, added array<struct<start, kind, end>>)."""
    occ = ws.put(occurrences(scanned), "occurrences")
    edges = ws.put(occ.groupBy("pattern", F.lower("value").alias("value")).agg(F.max("kind").alias("kind")), "edges")
    form = F.col("pattern").startswith("f ")
    enough = F.when(form, (F.col("support") >= FORM_SUPPORT) & (F.col("conf") >= FORM_CONF)).otherwise((F.col("support") >= min_support) & (F.col("conf") >= min_conf))
    best = F.max_by("of", F.struct("conf", -F.col("of")))
    for k in range(rounds):
        trusted = ws.put(confidence(ws, edges, f"r{k}").where(enough & (F.col("pure") >= 0.8)).select("pattern", "of", "conf"), f"trusted{k}")
        new = ws.put(edges.where("kind < 0").join(trusted, "pattern").groupBy("value").agg(best.alias("new")), f"new{k}")
        if new.isEmpty():
            break
        if k + 1 < rounds:
            edges = ws.put(edges.join(new, "value", "left").select("pattern", "value", F.when(F.col("kind") < 0, F.coalesce("new", "kind")).otherwise(F.col("kind")).alias("kind")), f"edges{k}")
    place = F.struct("key", "start", "value")
    found = occ.where("kind < 0").join(trusted, "pattern").groupBy(place.alias("p")).agg(best.alias("kind")).select("p.*", "kind")
    found = found.unionByName(occ.where(F.col("kind") >= len(NAMES)).select("key", "start", "value", "kind").distinct())
    span = F.struct("start", "kind", (F.col("start") + F.char_length("value")).alias("end"))
    return found.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("added"))


def _spell(spans: Column) -> Column:
    names = F.array(*map(F.lit, SEEDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, (s["kind"] + 1).cast("int")), s["start"].cast("string"), s["end"].cast("string"))))


def _count(code: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == code)).cast("long")


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].cast("int").alias("kind"), s["end"].cast("bigint").alias("end")))


def extract(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """Kept columns, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all), added (how many)."""
    ws = Workspace(docs.sparkSession, "pii")
    scanned = ws.put(scan(docs, keep), "scanned")
    added = discover(ws, scanned, **how)
    d = scanned.select("keep", "key", plain(F.col("base")).alias("base")).join(added, "key", "left")
    more = F.coalesce("added", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))
    every = F.array_sort(F.array_union("base", plain(more)))
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(NAMES)]
    return d.select(*unpacked("keep", keep), *counts, F.sha2(_spell(F.col("base")), 256).alias("base_sha256"), _spell(every).alias("spans"), F.size(more).alias("n_added"))


def redact(docs: DataFrame, **how) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; other columns stay, null texts too.

    Overlapping spans are replaced once, by the first one's kind.
    """
    ws = Workspace(docs.sparkSession, "pii")
    added = ws.put(discover(ws, ws.put(scan(docs, ()), "scanned"), **how), "added").select(F.col("key").alias("__key"), F.col("added").alias("__added"))
    keyed = docs.select(packed(docs.columns).alias("__row"), F.coalesce("text", F.lit("")).alias("text")).withColumn("__key", content_key())
    d = with_spans(keyed, words=False).join(added, "__key", "left")
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    d = d.withColumn("__all", F.array_sort(F.concat(plain(F.col("base")), plain(F.coalesce("__added", none)))))
    names = F.array(*map(F.lit, SEEDS))

    def step(acc, s):
        out = F.concat(acc["out"], F.substring(F.col("text"), (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int")), F.lit("["), F.upper(F.element_at(names, s["kind"] + 1)), F.lit("]"))
        return F.struct(F.when(s["start"] >= acc["pos"], out).otherwise(acc["out"]).alias("out"), F.greatest(acc["pos"], s["end"]).alias("pos"))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("pos"))
    new = F.aggregate("__all", zero, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["pos"] + 1).cast("int"), F.lit(2**31 - 1))))
    text = F.when(F.size("__all") > 0, new).otherwise(F.col("__row.text"))
    return d.select(*(text.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
