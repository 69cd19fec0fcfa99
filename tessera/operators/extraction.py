"""Entities and relations in narrative text by rules, with DataFrame functions.

Spans are found by splitting at a pattern and adding up lengths, so they have exact places. The gazetteer is an index
of surfaces by their rarest word, which a text's words join; overlapping spans are thinned by an ordered fold; a
trigger verb joins the nearest span before it with the nearest after it in its sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import reachable
from tessera.storage import stored

#: Tasks a core over which texts are dealt: about a million short texts are some minutes' work of a core.
TASKS = 8
SPAN = "struct<text string, kind string, start int, stop int, confidence double, uid string>"
# fixed values: names of months in dates
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"

# fixed values: recognisers of well-formed values, kind: (pattern, confidence)
RECOGNISERS: tuple[tuple[str, str, float], ...] = (
    ("phone", r"(?<![\d])(?:\+?91[\-\s]?|0)?(?:[6-9]\d{9}|[6-9]\d{1,3}[xX]{2,6}\d{2,4})(?![\d])", 0.96),
    ("vehicle", r"\b[A-Z]{2}[\s\-]?\d{1,2}[A-Z]?[\s\-]?[A-Z]{1,3}[\s\-]?\d{3,4}\b|\b[A-Z]{2}[\s\-]\d[A-Z][\s\-][A-Z]{2}[\s\-]\d{4}\b", 0.93),
    ("transaction", r"(?i)(?:₹|Rs\.?|INR)\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:lakh|lakhs|crore|crores|k))?|\b\d[\d,]*(?:\.\d+)?\s?(?:lakh|lakhs|crore|crores)\b", 0.94),
    ("case_record", r"(?i)\b(?:FIR|CASE|NX|WS|CR)[\s/\-]?\d{2,4}[\s/\-]?\d{2,4}\b|\b[A-Z]{2,6}/[A-Z]{2}-\d{4}-\d{3,4}\b", 0.90),
    ("social", r"(?<![\w])@[A-Za-z][A-Za-z0-9._]{2,29}\b", 0.92),
    ("social", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.90),
    ("phone", r"(?i)\b(?:IMEI[\s:]*)?\d{15}\b", 0.88),
    ("event", rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})(?:\s+\d{{4}})?\b|\b(?:{MONTHS})\s+\d{{1,2}}(?:,\s*\d{{4}})?\b|\b\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b", 0.85),
    ("event", r"(?i)\bDay\s+\d{1,3}\b", 0.85),
    ("organization", r"\b[A-Z][A-Za-z&.\-]*(?:\s+[A-Z][A-Za-z&.\-]*){0,4}\s+(?:Pvt\.?\s?Ltd\.?|Private\s+Limited|Ltd\.?|LLP|Limited|Co\.?|Company|Corporation|Enterprises|Traders|Trading|Logistics|Finserv|Industries|Services|Solutions|Agencies|Associates|Bank)\b", 0.88),
    ("person", r"\b[A-Z]\.\s?[A-Z][a-z]{2,}\b", 0.80),
)
# fixed values: the characters that each recogniser's matches may begin with
BEGINS = (r"+\d", "A-Z", r"₹RrIi\d", "A-Za-z", "@", r"A-Za-z0-9._%+\-", r"Ii\d", r"\dJFMASONDjfmasond", "Dd", "A-Z", "A-Z")
# fixed values: what each recogniser's matches hold in any case, a digit or @; other texts aren't searched
HOLD = ("[0-9]", "[0-9]", "[0-9]", "[0-9]", "@", "@", "[0-9]", "[0-9]", "[0-9]", "", "")
# fixed values: a title before a name, and the form of a name
HONORIFIC = r"\b(?:Mr|Mrs|Ms|Dr|Shri|Smt|Sh|Kum|Prof|Insp|SI|ASI|HC|Const)\.?\s+"
HONORIFIC_NAME = HONORIFIC + r"[A-Z][A-Za-z.]*(?:\s+[A-Z][A-Za-z.]*){0,3}"
CAPITALISED = r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){1,2}\b"
# fixed values: capitalised words that begin no name
NOT_NAMES = [
    "The", "This", "That", "These", "Those", "There", "Then", "They", "Their", "It", "Its", "As", "At", "On", "In", "By", "For", "From", "With",
    "Was", "Were", "Has", "Have", "Had", "Been", "Being", "And", "But", "Not", "All", "Any", "Case", "Report", "Police", "Station", "Sector", "Phone",
    "Number", "Vehicle", "Account", "Bank", "Transaction", "Records", "Record", "Date", "Day", "Time", "Location", "Address", "Suspect", "Victim",
    "Witness", "Accused", "Complainant", "Officer", "Investigation", "Statement", "Note", "Subject", "Further", "During", "After", "Before", "While",
    "When", "Where", "According", "Following", "Based", "Both", "Between", "Same", "Also", "However", "Additionally", "Subsequently", "Later",
    "Meanwhile",
]
# fixed values: marks around a word that don't belong to it
MARKS = ".,;:!?()[]\"'"
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z0-9])"
# fixed values: relation types and the verbs that trigger them
TRIGGERS = {
    "CALLED": r"\bcalled\b|\bcontacted\b|\bphoned\b|\brang\b|\bspoke (?:to|with)\b|\bcommunicated with\b|\bmade (?:a )?calls? to\b",
    "MET": r"\bmet\b|\bmeeting with\b|\bmet with\b|\brendezvous(?:ed)? with\b",
    "VISITED": r"\bvisited\b|\bwent to\b|\btravelled to\b|\btraveled to\b|\bpresent at\b",
    "TRANSFERRED_MONEY": r"\btransferred\b|\bremitted\b|\bpaid\b|\bsent (?:₹|Rs|money)\b|\bdeposited\b|\bcredited\b|\bwired\b",
    "OWNED": r"\bowns\b|\bowned\b|\bregistered (?:owner|to|in the name of)\b|\bbelongs to\b|\bin possession of\b|\busing (?:phone|number|vehicle)\b",
    "WORKED_FOR": r"\bworks? (?:for|at|with)\b|\bworked (?:for|at|with)\b|\bemployed (?:by|at)\b|\bemployee of\b",
    "ASSOCIATED_WITH": r"\bassociated with\b|\blinked (?:to|with)\b|\bconnected (?:to|with)\b|\baffiliated with\b",
    "sighted_at": r"\bsighted (?:at|near)\b|\bspotted (?:at|near)\b|\bseen (?:at|near|outside)\b|\bobserved (?:at|near)\b",
    "resides_at": r"\bresides? at\b|\bliving at\b|\blives at\b|\bresident of\b",
    "commutes_to": r"\bcommutes? (?:to|between)\b|\btravels? to work\b",
    "sent_messages_to": r"\bsent (?:messages?|texts?|sms)\b|\bmessaged\b|\bmessages? to\b",
    "complaint_filed_against": r"\bfiled a complaint against\b|\bcomplained against\b|\blodged (?:an? )?(?:FIR|complaint) against\b",
    "followed": r"\bfollowed\b|\btrailed\b|\bpursued\b|\bbeing followed by\b",
    "witnessed": r"\bwitnessed\b|\bsaw the\b|\bobserved the incident\b",
}


def begun(pattern: str, first: str) -> str:
    """The same matches, looked for only at these characters: a class is told faster than a word's bound or an alternative."""
    return f"(?=[{first}])(?:{pattern})"


def one_bound(pattern: str) -> str:
    r"""The same matches of \ba|\bb, ignoring case, with one test of the word's bound and of its first letter."""
    ways = pattern.removeprefix(r"\b").split(r"|\b")
    return begun(rf"\b(?:{'|'.join(ways)})", "".join(sorted({w[0].lower() + w[0].upper() for w in ways}))).replace("(?:", "(?:(?i)", 1)


def running(sizes: Column, block: int = 64) -> Column:
    """Array of the sums up to each of the sizes (not empty), by blocks, since an array that grows by one is copied each time.

    sizes must be a lambda's variable: any other expression in a lambda is worked out for each element.
    """
    none = F.array().cast("array<int>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    sums = lambda a: F.aggregate(a, none, lambda acc, x: F.concat(acc, F.array(last(acc) + x)))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: sums(F.slice(sizes, b * block + 1, F.lit(block))))
    whole = lambda bs: F.flatten(F.zip_with(bs, sums(F.transform(bs, last)), lambda b, total: F.transform(b, lambda x: x + total - last(b))))
    return F.get(F.transform(F.array(parts), whole), F.lit(0))


def all_matches(text: Column, patterns: list[str], few: int = 128) -> Column:
    """For each pattern the array of (text, start, stop) of all its matches, start from 0. One expression places them all."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,stop:int>>").alias("out"))
    span = lambda m, start, stop: F.struct(m.alias("text"), start.alias("start"), stop.alias("stop"))

    def found(pattern: str) -> Column:
        between = F.transform(F.split(text, pattern), lambda s: F.length(s))
        paired = lambda own: F.zip_with(own, F.slice(between, 1, F.size(own)), lambda m, gap: F.struct(m.alias("text"), gap.alias("gap")))
        none = F.array().cast("array<struct<text:string,gap:int>>")
        own = F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))  # a lambda's variable is worked out once
        return F.get(F.transform(own, lambda own: F.when(F.size(own) > 0, paired(own)).otherwise(none)), F.lit(0))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        stop = start + F.length(m["text"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span(m["text"], start, stop))).alias("out"))

    def many(p: Column) -> Column:
        stops = F.transform(F.array(F.transform(p, lambda m: m["gap"] + F.length(m["text"]))), lambda a: running(a))
        return F.zip_with(p, F.get(stops, F.lit(0)), lambda m, stop: span(m["text"], stop - F.length(m["text"]), stop))

    return F.transform(F.array(*map(found, patterns)), lambda p: F.when(F.size(p) <= few, F.aggregate(p, zero, step, lambda acc: acc["out"])).otherwise(many(p)))


def matches(text: Column, pattern: str) -> Column:
    """Array of (text, start, stop) of all matches, start from 0."""
    return F.get(all_matches(text, [pattern]), F.lit(0))


def exploded(df: DataFrame, items: Column, name: str, *others: str) -> DataFrame:
    """Other columns and a row for each item that isn't null.

    A plain explode has the optimizer filter rows by the size of the array first, which works out a costly array
    once more for the filter and once for the scan.
    """
    return df.select(*others, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def _spans(found: Column, kind: Column | str, confidence: Column | float) -> Column:
    value = confidence if isinstance(confidence, Column) else F.lit(confidence)
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.transform(found, lambda m: F.struct(m["text"].alias("text"), kind.alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), value.cast("double").alias("confidence"), F.lit(None).cast("string").alias("uid")))


def rule_spans(text: Column) -> Column:
    """All spans that rules find in a text, overlapping ones included."""
    parts = []
    for held in dict.fromkeys(HOLD):
        own = [(r, first) for r, first, h in zip(RECOGNISERS, BEGINS, HOLD, strict=True) if h == held]
        kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("confidence")) for (kind, _, c), _ in own))
        spans = F.flatten(F.zip_with(all_matches(text, [begun(p, first) for (_, p, _), first in own]), kinds, lambda found, k: _spans(found, k["kind"], k["confidence"])))
        parts.append(F.when(text.rlike(held), spans).otherwise(F.array().cast(f"array<{SPAN}>")) if held else spans)
    titled = F.transform(matches(text, begun(HONORIFIC_NAME, "MDSKPIAHC")), lambda m: F.struct(F.regexp_replace(m["text"], "^" + HONORIFIC, "").alias("text"), (m["stop"] - F.length(F.regexp_replace(m["text"], "^" + HONORIFIC, ""))).alias("start"), m["stop"].alias("stop")))
    parts.append(_spans(titled, "person", 0.94))
    names = F.filter(matches(text, begun(CAPITALISED, "A-Z")), lambda m: ~F.regexp_extract(m["text"], r"^\S+", 0).isin(*NOT_NAMES))
    begins = lambda m: (m["start"] == 0) | F.trim(F.substring(text, F.greatest(m["start"] - 1, F.lit(1)), F.least(m["start"], F.lit(2)))).isin(".", "!", "?", "")
    plain = F.transform(names, lambda m: F.struct(m["text"].alias("text"), F.lit("person").alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), F.when(begins(m), 0.68).otherwise(0.76).alias("confidence"), F.lit(None).cast("string").alias("uid")))
    return F.concat(*parts, plain)


def gazetteer(entities: DataFrame) -> DataFrame:
    """(norm, uid, kind, part): a surface's normal form to its first entity (by uid); parts of names that one person has."""
    surface = entities.select("uid", F.col("type").alias("kind"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("surface"))
    surface = surface.where(F.length("surface") >= 2)
    whole = surface.select(T.normal(F.col("surface"), F.col("kind")).alias("norm"), "uid", "kind").where("norm <> ''")
    first = whole.groupBy("norm").agg(F.min(F.struct("uid", "kind")).alias("e")).select("norm", "e.uid", "e.kind", F.lit(False).alias("part"))
    parts = surface.where("kind = 'person'").withColumn("words", T.words(F.col("surface"))).where(F.size("words") > 1)
    parts = parts.select("uid", F.explode("words").alias("w")).select("uid", F.lower(F.regexp_replace("w", r"^\.+|\.+$", "")).alias("norm")).where(F.length("norm") >= 3)
    owned = parts.groupBy("norm").agg(F.min("uid").alias("uid"), F.count_distinct("uid").alias("owners")).where("owners = 1")
    return first.union(owned.select("norm", "uid", F.lit("person").alias("kind"), F.lit(True).alias("part")))


def surface_index(known: DataFrame, longest: int = 6) -> DataFrame:
    """(core, norm, uid, kind, part, most): each surface of a gazetteer under the rarest of its words.

    Rare is what few surfaces have (ties: the smaller word); a word counts without marks around it. most is the number
    of words of the longest surface, at most `longest`; longer surfaces are left out, since no text is searched for them.
    """
    named = known.withColumn("words", F.split("norm", " "))
    most = named.agg(F.least(F.max(F.size("words")), F.lit(longest)).alias("most"))
    surfaces = named.where(F.size("words") <= longest)
    cores = F.array_distinct(F.filter(F.transform("words", lambda w: _core(w)), lambda c: c != ""))
    rows = exploded(surfaces.withColumn("cores", cores), F.col("cores"), "core", "norm", "uid", "kind", "part")
    common = rows.groupBy("core").agg(F.count("*").alias("n"))
    rarest = rows.join(common, "core").groupBy("norm", "uid", "kind", "part").agg(F.min(F.struct("n", "core")).alias("r"))
    return rarest.select("r.core", "norm", "uid", "kind", "part").join(F.broadcast(most))  # one row


def _core(word: Column) -> Column:
    return F.regexp_replace(word, r"""^[.,;:!?()\[\]"']+|[.,;:!?()\[\]"']+$""", "")


def listed_spans(text: str | None, surfaces: list[dict]) -> list[dict]:
    """Spans of the surfaces in a text: of overlapping ones that of more words stays, then the earlier; then parts of names.

    A surface is looked for only where its rarest word stands. Words that are marks alone may lie at a span's ends.
    """
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text or "", re.ASCII)]
    cores = [text[a:z].strip(MARKS).lower() for a, z in words]
    wanted: dict[str, list[dict]] = {}
    for s in surfaces:
        wanted.setdefault(s["core"], []).append(s)
    hits, parts = {}, []
    for i, core in enumerate(cores):
        for s in wanted.get(core, ()):
            if s["part"]:
                parts.append((i, s))
                continue
            own = s["norm"].split(" ")
            for at in (k for k, w in enumerate(own) if w.strip(MARKS) == core):
                first, last = i - at, i - at + len(own) - 1
                if first < 0 or last >= len(words):
                    continue
                room = s["most"] - len(own)
                before = next((k for k in range(room + 1) if k >= first or cores[first - k - 1]), room)
                after = next((k for k in range(room + 1) if last + k + 1 >= len(words) or cores[last + k + 1]), room)
                for k in range(before + 1):
                    for m in range(min(after, room - k) + 1):
                        a, z = words[first - k][0], words[last + m][1]
                        clean = text[a:z].strip(MARKS)
                        if len(clean) >= 2 and re.sub(r"\s+", " ", clean, flags=re.ASCII).strip(" ").lower().rstrip(".") == s["norm"]:
                            hits[first - k, last + m] = (s, clean, a + text[a:z].find(clean))
    taken: set[int] = set()
    out = []
    for (first, last), (s, clean, start) in sorted(hits.items(), key=lambda h: (h[0][0] - h[0][1], h[0][0])):
        if taken.isdisjoint(range(first, last + 1)):
            taken.update(range(first, last + 1))
            out.append({"text": clean, "kind": s["kind"], "start": start, "stop": start + len(clean), "confidence": 0.97, "uid": s["uid"]})
    for i, s in parts:
        a, z = words[i]
        clean = text[a:z].strip(MARKS)
        if i not in taken and len(clean) >= 3 and clean[0].isupper() and clean.lower() == s["norm"]:
            start = a + text[a:z].find(clean)
            out.append({"text": clean, "kind": s["kind"], "start": start, "stop": start + len(clean), "confidence": 0.86, "uid": s["uid"]})
    return out


def _listed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, surfaces in batches:
        yield pd.Series([listed_spans(t, [] if s is None else list(s)) for t, s in zip(texts, surfaces, strict=True)])


def candidates(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(id, surfaces): the surfaces whose rarest word a text of (id, text) has.

    A row for each different word of a text meets the index; where that is small enough for Spark to broadcast it,
    only hits are shuffled. Texts aren't.
    """
    cores = F.array_distinct(F.transform(F.split("text", r"\s+"), lambda w: F.lower(_core(w))))
    words = exploded(docs.select("id", cores.alias("cores")), F.col("cores"), "core", "id").where("core <> ''")
    return words.join(index, "core").groupBy("id").agg(F.collect_list(F.struct(*index.columns)).alias("surfaces"))


def gazetteer_spans(docs: DataFrame, known: DataFrame, longest: int = 6) -> DataFrame:
    """(id, text, listed): documents (id, text) with the spans of known surfaces, each word in one span at most.

    Rows without id or with an id that other rows have are searched for the surfaces of all rows of that id: the
    result is the same. Null texts hold no span.
    """
    reachable(docs.sparkSession)
    listed = F.pandas_udf(_listed, f"array<{SPAN}>")
    found = candidates(docs, stored(surface_index(known, longest), "surfaces")).withColumnRenamed("id", "of")
    both = docs.select("id", "text").join(found, F.col("id").eqNullSafe(F.col("of")), "left")
    return both.select("id", "text", F.when(F.col("surfaces").isNotNull(), listed("text", "surfaces")).otherwise(F.array().cast(f"array<{SPAN}>")).alias("listed"))


def thinned(spans: Column) -> Column:
    """Spans without overlaps: longer ones first, then the more certain, then the earlier; in order of start."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct((-(s["stop"] - s["start"])).alias("a"), (-s["confidence"]).alias("b"), s["start"].alias("c"), s.alias("s"))))
    zero = F.array().cast(f"array<{SPAN}>")
    free = lambda acc, s: ~F.exists(acc, lambda k: (s["stop"] > k["start"]) & (s["start"] < k["stop"]))
    kept = F.aggregate(ranked, zero, lambda acc, r: F.when(free(acc, r["s"]), F.concat(acc, F.array(r["s"].cast(SPAN)))).otherwise(acc))
    return F.array_sort(kept, lambda x, y: x["start"] - y["start"])


def sentences(text: Column) -> Column:
    """Array of (text, start, stop) of a text's sentences."""
    gaps = matches(text, SENTENCE)
    starts = F.concat(F.array(F.lit(0)), F.transform(gaps, lambda g: g["stop"]))
    stops = F.concat(F.transform(gaps, lambda g: g["start"]), F.array(F.length(text)))
    return F.zip_with(starts, stops, lambda a, z: F.struct(F.substring(text, a + 1, z - a).alias("text"), a.alias("start"), z.alias("stop")))


def entities_in(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, text, spans) of documents (id, text).

    With a gazetteer, known surfaces are spans too, and a span of a rule whose normal form (for its kind) is a known
    surface gets that entity's uid and kind.
    """
    own = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    if known is None:
        return own.select("id", "text", thinned(rule_spans(F.col("text")).cast(f"array<{SPAN}>")).alias("spans"))
    found = gazetteer_spans(own, known).select("id", "text", thinned(F.concat(rule_spans(F.col("text")).cast(f"array<{SPAN}>"), "listed")).alias("spans"))
    return _linked(stored(found, "spans"), known)


def _linked(found: DataFrame, known: DataFrame) -> DataFrame:
    """(id, text, spans), where spans without a uid have that of the surface equal to their normal form."""
    form = lambda s: T.normal(s["text"], s["kind"])
    forms = F.array_distinct(F.transform(F.filter("spans", lambda s: s["uid"].isNull()), form))
    rows = exploded(found.select("id", forms.alias("forms")), F.col("forms"), "norm", "id").distinct()
    hits = rows.join(known.where("not part"), "norm").groupBy(F.col("id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("norm", F.struct("uid", "kind")))).alias("hits"))
    both = found.join(hits, F.col("id").eqNullSafe(F.col("of")), "left")
    hit = lambda s: F.when(s["uid"].isNull(), F.try_element_at("hits", form(s)))
    named = F.transform("spans", lambda s: F.struct(s["text"].alias("text"), F.coalesce(hit(s)["kind"], s["kind"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["confidence"].alias("confidence"), F.coalesce(s["uid"], hit(s)["uid"]).alias("uid")).cast(SPAN))
    return both.select("id", "text", F.when(F.col("hits").isNull(), F.col("spans")).otherwise(named).alias("spans"))


def relations_in(found: DataFrame, kinds: bool = False) -> DataFrame:
    """(id, source, target, type, confidence, source_uid, target_uid, trigger_start) of documents (id, text, spans).

    With kinds also source_kind and target_kind: that of the text's first span of those letters, whatever their case.
    """
    every = ["every"] if kinds else []
    found = found.where(F.size("spans") >= 2).select("id", "text", "spans", *(F.col("spans").alias(c) for c in every))
    s = exploded(found, sentences(F.col("text")), "s", "id", "spans", *every)
    inside = F.filter("spans", lambda e: (e["start"] >= F.col("s.start")) & (e["stop"] <= F.col("s.stop")))
    s = s.select("id", "s", inside.alias("spans"), *every).where(F.size("spans") >= 2)
    at, types = F.col("s.start"), F.array(*map(F.lit, TRIGGERS))
    triggers = all_matches(F.col("s.text"), [one_bound(p) for p in TRIGGERS.values()])
    verbs = F.flatten(F.zip_with(triggers, types, lambda found, k: F.transform(found, lambda m: F.struct(k.alias("type"), (m["start"] + at).alias("start"), (m["stop"] + at).alias("stop")))))
    t = exploded(s, verbs, "t", "id", "s", "spans", *every)
    before = F.filter("spans", lambda e: e["stop"] <= F.col("t.start"))
    after = F.filter("spans", lambda e: e["start"] >= F.col("t.stop"))
    t = t.select("id", "s", "t", before.alias("before"), after.alias("after"), *every).where((F.size("before") > 0) & (F.size("after") > 0))
    t = t.select("id", "s", "t", F.try_element_at("before", F.lit(-1)).alias("x"), F.get("after", F.lit(0)).alias("y"), "after", *every)
    near = F.greatest(F.lit(0.4), 1 - (F.col("y.start") - F.col("x.stop")) / 220)
    sure = F.round(F.least(F.lit(0.95), 0.55 + 0.35 * near) * (F.col("x.confidence") + F.col("y.confidence")) / 2, 3)
    t = t.withColumn("confidence", sure)
    row = lambda target, c: F.struct(F.col("x.text").alias("source"), target["text"].alias("target"), F.col("t.type").alias("type"), c.alias("confidence"), F.col("x.uid").alias("source_uid"), target["uid"].alias("target_uid"), F.col("t.start").alias("trigger_start"))
    payee = F.get(F.filter("after", lambda e: (e["start"] > F.col("y.stop")) & e["kind"].isin("organization", "person")), F.lit(0))
    t = t.withColumn("payee", F.when((F.col("t.type") == "TRANSFERRED_MONEY") & (F.col("y.kind") == "transaction"), payee))
    between = F.expr("substring(s.text, y.stop - s.start + 1, payee.start - y.stop)")
    paid = F.col("payee").isNotNull() & between.rlike(r"(?i)\b(?:to|into|towards|in favour of)\b")
    rows = F.when(paid, F.array(row(F.col("y"), F.col("confidence")), row(F.col("payee"), F.round(F.col("confidence") * 0.97, 3)))).otherwise(F.array(row(F.col("y"), F.col("confidence"))))
    out = t.select("id", F.explode(rows).alias("r"), *every)
    kind = lambda end: F.get(F.filter("every", lambda e: F.lower(e["text"]) == F.lower(F.col(f"r.{end}"))), F.lit(0))["kind"].alias(f"{end}_kind")
    out = out.select("id", "r.*", *(kind(end) for end in ("source", "target") if kinds))
    best = Window.partitionBy("id", F.lower("source"), "type", F.lower("target")).orderBy(F.desc("confidence"), "trigger_start")
    return out.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def summary(found: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, n_entities, n_known, n_new, n_unsure, n_relations, confidence): observations about the extraction itself."""
    r = relations.groupBy("id").agg(F.count("*").alias("n"), F.sum("confidence").alias("sure"))
    e = found.select("id", F.size("spans").alias("n_entities"), F.size(F.filter("spans", lambda s: s["uid"].isNotNull())).alias("n_known"), F.size(F.filter("spans", lambda s: s["confidence"] < 0.75)).alias("n_unsure"), F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["confidence"]).alias("total"))
    n = F.coalesce("n", F.lit(0))
    count = F.col("n_entities") + n
    return e.join(r, "id", "left").select("id", "n_entities", "n_known", (F.col("n_entities") - F.col("n_known")).alias("n_new"), "n_unsure", n.alias("n_relations"), F.when(count > 0, (F.col("total") + F.coalesce("sure", F.lit(0.0))) / count).otherwise(0.0).alias("confidence"))
