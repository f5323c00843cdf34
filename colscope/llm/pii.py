r"""Personal data by candidate gradient boosting, in built-in functions only.

Generators with high recall propose spans, which may overlap: the four base patterns, and looser ones (spelled-out and
spaced addresses, addresses with letters beyond ASCII, IPv6, cards in dotted groups, national and 00 phone numbers, and what
the base patterns match but their checks refuse). Each candidate becomes numbers about its form and its surroundings, and
boosted trees, trained here, score it. Scores of labelled candidates that the trees haven't seen give a rising curve of
precision for each kind, and from it the threshold above which a candidate is redacted. Base spans always stay. An added
span that overlaps a base span, or an added one that starts further left (of those with one start the longer, then the
better scored), is left out.

Labels come from two places: sentences written by hand, with random digits, and at most `SAMPLE` candidates of the corpus
whose label is known by rule (base spans are right; matches that fail the base checks, and candidates that cut or stretch a
base span, are wrong). The trees are a column expression, so scoring is part of one scan of the texts, without a shuffle.

Places are code points from 0, ends exclusive; a base pattern's matches are found from the left without overlap over the
whole text, as one long text would be by hand. A null text is empty and has no spans. Rows repeat as they are, and null ids
stay null. An empty table gives an empty table. Other columns are not read, and pass through `redacted`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.staging import staged
from colscope.llm.common import quoted, unpacked, whole_rows

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000  # labelled candidates of the corpus
VARIANTS = 48  # of each sentence
TREES, DEPTH, RATE = 24, 4, 0.3
PRECISION = 0.97
CONTEXT = 40
STEP = 256  # elements that a running sum adds up at once

# The four base patterns. Runs are taken whole and only from their first character, which changes no match
# and keeps long runs linear.
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
OCTETS = rf"^{PART}(?:\.{PART}){{3}}$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column], start: int) -> Column:
    """What `add` makes of all elements up to each, in steps, so that a long array isn't copied for each of its elements."""
    def inside(part: Column, first: Column) -> Column:
        empty = F.struct(first.alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(part, empty, lambda acc, x: let(add(acc["sum"], x), lambda total: F.struct(
            total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))), lambda acc: acc["all"])

    def whole(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int"))
        empty = F.struct(F.lit(start).alias("sum"), F.array().cast("array<array<int>>").alias("all"))
        return F.flatten(F.aggregate(F.transform(places, lambda k: F.slice(v, k * STEP + 1, F.lit(STEP))), empty, lambda acc, part: let(
            inside(part, acc["sum"]), lambda out: F.struct(F.element_at(out, -1).alias("sum"), F.concat(acc["all"], F.array(out)).alias("all"))),
            lambda acc: acc["all"]))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, whole))


def earlier(upto: Column, start: int) -> Column:
    """The same without the element itself."""
    return F.slice(F.concat(F.array(F.lit(start)), upto), 1, F.size(upto))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit; false for strings that are too long for a card."""
    def weighed(d: Column, i: Column) -> Column:
        n = d.cast("int") * (i % 2 + 1)
        return F.when(n > 9, n - 9).otherwise(n)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), weighed), F.lit(0), lambda a, x: a + x)
    return F.when((F.length(digits) > 0) & (F.length(digits) <= 32), total % 10 == 0).otherwise(False)


#: Whether a match of a base pattern passes its check.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(OCTETS),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


@dataclass(frozen=True)
class Generator:
    """A pattern that proposes spans of a kind. Only texts with a match of `gate` are searched; of the matches, `worth` says
    which are candidates."""

    kind: str
    pattern: str
    gate: Callable[[Column], Column]
    worth: Callable[[Column], Column] = lambda v: F.lit(True)
    base: bool = False


def _between(least: int, most: int) -> Callable[[Column], Column]:
    return lambda v: F.length(_digits(v)).between(least, most)


def _has(part: str) -> Callable[[Column], Column]:
    return lambda text: F.contains(text, F.lit(part))


OPEN, SHUT = r" ?[\[({<] ?", r" ?[\])}>] ?"
GENERATORS = (
    Generator("email", BASE["email"], _has("@"), base=True),
    Generator("email", rf"(?<!{LOCAL}){LOCAL}{{1,64}}+ ?@ ?{LABEL}{{1,63}}+(?: ?\. ?{LABEL}{{2,63}}+){{1,4}}+", _has("@")),
    Generator("email", rf"(?i)(?<!{LOCAL}){LOCAL}{{1,64}}+(?:{OPEN}at{SHUT}| at ){LABEL}{{1,63}}+(?:(?:{OPEN}dot{SHUT}| dot |\.){LABEL}{{2,63}}+){{1,4}}+",
              lambda t: t.rlike(r"(?i)[\[({< ]at[\])}> ]") & t.rlike(r"(?i)[\[({< ]dot[\])}> ]")),
    Generator("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}+", _has("@")),
    Generator("ip", BASE["ip"], lambda t: t.rlike(r"[0-9]\.[0-9]"), base=True),
    Generator("ip", "(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}+(?::?[0-9A-Fa-f]{1,4}){1,6}+(?![0-9A-Za-z:])", _has(":")),
    Generator("card", BASE["card"], lambda t: t.rlike("[0-9](?:[ -]?[0-9]){12}"), _between(13, 19), base=True),
    Generator("card", r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", lambda t: t.rlike("[0-9]{4}[._/][0-9]{4}")),
    Generator("phone", BASE["phone"], _has("+"), _between(7, 16), base=True),
    Generator("phone", r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])", lambda t: t.rlike("[0-9]{3}[ .-][0-9]{3}")),
    Generator("phone", "(?<![0-9])00[1-9][0-9 ().-]{6,20}[0-9](?![0-9])", _has("00"), _between(9, 17)),
)


def _located(text: Column, hits: Column, g: Generator) -> Column:
    """Candidates of a generator: kind, start, end, value, surroundings, base (it passes the base check) and by_base (a base
    pattern matched it). Places come from the lengths of the matches and of what lies between them."""
    def candidates(gaps: Column) -> Column:
        both = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))

        def one(end: Column, n: Column) -> Column:
            value = F.get(hits, n)
            return F.struct(F.lit(KINDS.index(g.kind)).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"),
                            value.alias("value"), F.substring(F.get(gaps, n), -CONTEXT, CONTEXT).alias("left"),
                            F.substring(F.get(gaps, n + 1), 1, CONTEXT).alias("right"),
                            (CHECKS[g.kind](value) if g.base else F.lit(False)).alias("base"), F.lit(g.base).alias("by_base"))

        return F.transform(running(both, lambda a, b: a + b, 0), one)

    worth = lambda c: c["base"] | g.worth(c["value"])
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string,left:string,right:string,base:boolean,by_base:boolean>>")
    return F.when(F.size(hits) == 0, none).otherwise(F.filter(let(F.split(text, g.pattern, -1), candidates), worth))


def _barrier(rows: DataFrame, *columns: Column) -> DataFrame:
    """These columns, kept from being worked out again wherever they are used."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def proposed(docs: DataFrame, kept: Sequence[Column], text: str = "text") -> DataFrame:
    """The columns `kept` and `candidates` of each text, with the numbers that the trees look at."""
    texts = docs.select(*kept, F.coalesce(quoted(text), F.lit("")).alias("the text"))
    names = [c for c in texts.columns if c != "the text"]
    hits = [F.when(g.gate(F.col("the text")), F.regexp_extract_all("the text", F.lit(g.pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>")).alias(f"hits {n}") for n, g in enumerate(GENERATORS)]
    own = [quoted(c) for c in names]
    found = _barrier(texts, *own, F.col("the text"), *hits)
    spans = F.concat(*[_located(F.col("the text"), F.col(f"hits {n}"), g) for n, g in enumerate(GENERATORS)])
    found = _barrier(found, *own, spans.alias("candidates"))
    seen = F.transform("candidates", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"),
                                                        c["by_base"].alias("by_base"), F.array(*features(c).values()).alias("features")))
    return found.select(*own, seen.alias("candidates"))


CUES = {
    "cue_email": "mail|contact|write to|reach|kontakt|correo|courriel|schreib",
    "cue_phone": r"phone|\btel|\bcall|mobile|\bcell|\bfax|dial|whatsapp|hotline|telefon|tel[eé]fono|t[eé]l[eé]phone|rufnummer",
    "cue_ip": r"\bip\b|address|host|server|login|logged|client|connect|peer|router|subnet|ping",
    "cue_card": r"card|visa|mastercard|amex|credit|debit|payment|paid|karte|carte|tarjeta",
    "cue_other": (r"version|release|\bv\.? ?$|order|invoice|\bno\.?\b|\bref|isbn|issn|section|chapter|\bpage|build|\bdoi|figure|table|serial|tracking|"
                  r"\bid\b|sku|\bpart\b|article|account|customer|ticket|firmware|kernel|clause|population|budget|score|lot\b|batch|meter"),
    "cue_time": r"\btime|\bdate|clock|\bat ?$|uhr|heure|hora|elapsed|duration|mac\b",
}


def features(c: Column) -> dict[str, Column]:
    """Numbers about the form of a candidate and its surroundings."""
    value, left, right = c["value"], c["left"], c["right"]
    digits = _digits(value)
    count = lambda pattern: F.regexp_count(value, F.lit(pattern))
    numbers = {
        "kind": c["kind"], "n_chars": F.length(value), "n_digits": F.length(digits), "n_letters": count(r"\p{L}"), "n_spaces": count(" "),
        "n_dots": count(r"\."), "n_dashes": count("-"), "n_colons": count(":"), "n_groups": count("[0-9A-Za-z]+"), "n_kinds_of_digit":
        F.size(F.array_distinct(F.split(digits, ""))), "longest_group": F.coalesce(F.array_max(F.transform(
            F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0)),
        "end_letters": F.length(F.regexp_extract(value, "[A-Za-z]*$", 0)),
    }
    flags = {
        "luhn": luhn(digits), "octets": value.rlike(OCTETS), "plus": value.startswith("+"), "zeros": digits.startswith("00"),
        "brackets": value.rlike(r"[\[({<]"), "at": F.contains(value, F.lit("@")), "spelled": value.rlike(r"(?i)[\[({< ]dot[\])}> ]"),
        "bracketed_at": value.rlike(r"(?i)[\[({<] ?at ?[\])}>]"), "spaced_at": value.rlike(" @|@ "), "beyond_ascii": value.rlike(r"[^\x00-\x7F]"),
        "upper_after_dot": value.rlike(r"\. ?[A-Z][a-z]"), "hex": value.rlike("[A-Fa-f]") & F.contains(value, F.lit(":")),
        "issuer": digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        "joined_left": left.rlike(r"[\p{L}\p{N}_]$"), "joined_right": right.rlike(r"^[\p{L}\p{N}_]"), "mark_left": left.rlike("[=/#$€£:_%.,+-] ?$"),
        "digit_left": left.rlike("[0-9][ .,:-]?$"), "digit_right": right.rlike("^[ .,:-]?[0-9]"), "mark_right": right.rlike("^[%€$/:°=_+-]"),
        "unit_right": right.rlike("^ ?(?:kg|km|px|ms|mm|cm|MB|GB|%|USD|EUR|units|euros?|dollars?)"),
        **{name: left.rlike(f"(?i)(?:{pattern})[^.!?]{{0,30}}$") for name, pattern in CUES.items()},
    }
    return {k: v.cast("double") for k, v in (numbers | flags).items()}


# Sentences for the trees: kind, what stands before, the span, what stands after, and whether it is personal data. Each # is
# a random digit, ~ the digit that makes a card number right, ! one that makes it wrong.
RIGHT, WRONG = True, False
SENTENCES = (
    ("email", "please mail ", "jane.doe##@example.org", " for details.", RIGHT), ("email", "", "k_smith@mail#.example.com", " wrote this", RIGHT),
    ("email", "contact: ", "r.weber@uni-stadt.de", ", room ##", RIGHT), ("email", "reach me under ", "jane.doe at example dot org", " please", RIGHT),
    ("email", "reach me under ", "doe## [at] example [dot] org", " please", RIGHT), ("email", "write to ", "anna(at)example(dot)com", " soon", RIGHT),
    ("email", "my mail is ", "max.muster at example dot de", ".", RIGHT), ("email", "e-mail ", "info @ example . com", " any time", RIGHT),
    ("email", "courriel : ", "rené.dupré@exemple.fr", " ou par la poste", RIGHT), ("email", "correo ", "muñoz##@ejemplo.es", ".", RIGHT),
    ("email", "von ", "jörg.müller@firma.de", " kam die Antwort", RIGHT), ("email", "the host said ", "bob{at}example{dot}net", "", RIGHT),
    ("email", "we looked ", "down at the dot pattern", " on the wall", WRONG), ("email", "she was ", "there at noon. Then", " they left", WRONG),
    ("email", "look ", "closely at every dot and", " line", WRONG), ("email", "buy apples ", "@ 3 each. They", " are fresh", WRONG),
    ("email", "the price is 5 ", "pieces @ 12.50", " in total", WRONG), ("email", "follow ", "news @ noon . Then", " more", WRONG),
    ("email", "the decorator ", "x@y. Next", " line", WRONG), ("email", "he stared ", "up at one dot far", " away", WRONG),
    ("email", "meet me ", "tomorrow at cafe dot later", " we go", WRONG),
    ("ip", "logged in from ", "1##.##.2#.1##", " at noon", RIGHT), ("ip", "the server ", "10.#.#.##", " answered", RIGHT), ("ip", "", "8#.#.1##.4#", " joined", RIGHT),
    ("ip", "his address was ", "2001:db8:##:#::##a", ".", RIGHT), ("ip", "ping ", "fe80:#:#:##:a#ff:fe##:#b:##", " failed", RIGHT),
    ("ip", "connect to ", "2a0#:4f8:c#:##f::#", " by name", RIGHT), ("ip", "host ", "2001:db8:#f#:a##:##:##:#:#", " is down", RIGHT),
    ("ip", "text and ", "1##.2#.9#.7#", " more words of prose", RIGHT), ("ip", "see version ", "3##.4##.9##.7##", " of it", WRONG),
    ("ip", "section ", "9##.1#.2#.3##", " says", WRONG), ("ip", "at ", "1#:2#:4#", " the train left", WRONG), ("ip", "time ", "0#:1#:3#", "", WRONG),
    ("ip", "the lap took ", "01:0#:5#:2#", " in all", WRONG), ("ip", "mac ", "0#:1a:2b:#c:4d:5e", " of the card", WRONG), ("ip", "ratio ", "16:9:#", " or so", WRONG),
    ("ip", "build ", "4##.#.30##.5##", " is out", WRONG), ("ip", "verses ", "3:1#:2#", " and on", WRONG), ("ip", "elapsed ", "#:##:##", ".", WRONG),
    ("card", "my card ", "4###########~", " is valid", RIGHT), ("card", "paid with visa ", "4### #### #### ###~", " today", RIGHT),
    ("card", "mastercard ", "53##-####-####-###~", "", RIGHT), ("card", "prose ", "45#############~", " more prose", RIGHT), ("card", "amex ", "37## ###### ####~", ".", RIGHT),
    ("card", "credit card ", "34############~", " expires", RIGHT), ("card", "the card number is ", "4###.####.####.###~", " as noted", RIGHT),
    ("card", "payment by ", "6011/####/####/###~", " went through", RIGHT), ("card", "debit ", "51##_####_####_###~", " used", RIGHT),
    ("card", "words and ", "4### #### #### ###!", " words", WRONG), ("card", "order no ", "9#############!", " shipped", WRONG),
    ("card", "invoice ", "2024-####-####-###!", " is due", WRONG), ("card", "tracking ", "1#################!", " on its way", WRONG),
    ("card", "isbn ", "978-#-####-####-#", "", WRONG), ("card", "isbn ", "978##########", " in print", WRONG), ("card", "serial ", "8###.####.####.###!", " on the back", WRONG),
    ("card", "id ", "7##############", " in the base", WRONG), ("card", "at ", "17###########", " milliseconds", WRONG), ("card", "lot ", "2023/####/####/###!", " recalled", WRONG),
    ("card", "telephone ", "0044 20 #### ###~", " please", WRONG), ("card", "call ", "0049 30 #### ###~", " now", WRONG), ("card", "words ", "00## #### #### ###~", " words", WRONG),
    ("card", "fax ", "001 2## 555 ###~", ".", WRONG), ("card", "order no ", "1##########~", " came", WRONG), ("card", "serial ", "0############~", " on it", WRONG),
    ("card", "years ", "1984 1985 1986 1987", " were dry", WRONG), ("card", "scores of ", "12 14 15 17 19 20 22", " points", WRONG),
    ("card", "account ", "8### #### #### ##", " closed", WRONG), ("card", "population ", "1################!", " in all", WRONG),
    ("phone", "call ", "+1 (###) 555-####", " now", RIGHT), ("phone", "tel ", "+49 30 9## ####", ".", RIGHT), ("phone", "words ", "+44 20 7### ####", " words", RIGHT),
    ("phone", "phone: ", "(2##) 555-####", " after six", RIGHT), ("phone", "call me at ", "3##-555-####", " tonight", RIGHT), ("phone", "fax ", "0049 30 9## ####", "", RIGHT),
    ("phone", "mobile ", "2##.555.####", " or mail", RIGHT), ("phone", "dial ", "0033 1 4# ## ## ##", " first", RIGHT), ("phone", "whatsapp ", "9## 555 ####", "", RIGHT),
    ("phone", "telephone ", "0044 1### ######", ".", RIGHT), ("phone", "ring ", "0041 44 ### ## ##", " first", RIGHT), ("phone", "tel. ", "0044 20 7### ####", " for us", RIGHT),
    ("phone", "the fax number ", "001 2## 555 ####", "", RIGHT), ("phone", "or call ", "0043-1-5######", ".", RIGHT), ("phone", "dial us at ", "0039 06 #### ####", ",", RIGHT),
    ("phone", "telefon ", "030 9## ####", " abends", RIGHT), ("phone", "hotline ", "(0##) ###-####", " is open", RIGHT), ("phone", "our cell is ", "2## ###-####", ".", RIGHT),
    ("phone", "part ", "4##-2##-9###", " is sold out", WRONG), ("phone", "order ", "1## 2## 3##", " came late", WRONG), ("phone", "population ", "12 345 678", " people", WRONG),
    ("phone", "about ", "3## 4## 5##", " units were sold", WRONG), ("phone", "pages ", "101 102 103", " and on", WRONG), ("phone", "invoice ", "20## 0### 1###", " paid", WRONG),
    ("phone", "budget of ", "12.500.000", " euros", WRONG), ("phone", "a total of ", "###.###.###", " dollars", WRONG), ("phone", "clause ", "12.345.678", " applies", WRONG),
    ("phone", "sum ", "+1 +2", " is three", WRONG), ("phone", "growth of ", "+12.5 - 13.75", " percent", WRONG), ("phone", "ticket ", "00#### ##### ####", " was closed", WRONG),
    ("phone", "serial ", "00##############", " on the back", WRONG), ("phone", "score ", "+100 200 300 400 500 6", " so far", WRONG), ("phone", "between ", "1990-1995-2001", " it grew", WRONG),
    ("phone", "the years ", "1914 1939 1989", " changed it", WRONG), ("phone", "batch ", "###-####-###", " failed", WRONG), ("phone", "table ", "100 2000 3000", " shows", WRONG),
)


def lessons(spark: SparkSession, variants: int = VARIANTS) -> DataFrame:
    """The sentences, each with several draws of digits: kind, value, left, right, right_one (whether it is personal data)."""
    sentences = F.array(*[F.struct(F.lit(KINDS.index(k)).alias("kind"), F.lit(a).alias("left"), F.lit(v).alias("value"), F.lit(b).alias("right"),
                                   F.lit(y).alias("right_one")) for k, a, v, b, y in SENTENCES])
    rows = spark.range(0, variants, 1, 1).select("id", F.posexplode(sentences).alias("n", "s")).select("id", "n", "s.*")

    def drawn(text: Column) -> Column:
        digit = lambda i: F.pmod(F.xxhash64("id", "n", i), F.lit(10)).cast("string")
        return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c == "#", digit(i)).otherwise(c)), "")

    def checked(text: Column) -> Column:
        def with_digit(mark: str, wanted: Callable[[Column], Column]) -> Column:
            tried = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.replace(text, F.lit(mark), d.cast("string")))
            return F.get(F.filter(tried, lambda v: wanted(luhn(_digits(v)))), F.lit(0))

        return (F.when(F.contains(text, F.lit("~")), with_digit("~", lambda ok: ok))
                .when(F.contains(text, F.lit("!")), with_digit("!", lambda ok: ~ok)).otherwise(text))

    rows = rows.withColumn("value", drawn(F.col("value"))).withColumn("right", drawn(F.col("right")))
    return rows.withColumn("value", checked(F.col("value")))


def corpus_lessons(candidates: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most about `sample` candidates with a label known by rule: features, right_one, draw."""
    known = F.transform(F.col("candidates"), lambda c: F.struct(c["features"].alias("features"), F.when(c["by_base"], c["base"]).when(F.exists(
        "candidates", lambda b: b["base"] & (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"]) &
        ((b["start"] != c["start"]) | (b["end"] != c["end"]))), F.lit(False)).alias("right_one")))
    few = F.size("candidates") <= STEP  # beyond, the comparison of all with all would be long; such texts aren't learned from
    rows = candidates.filter(few).select(F.explode(F.filter(known, lambda c: c["right_one"].isNotNull())).alias("c"), F.xxhash64("candidates").alias("of"))
    rows = rows.select("c.*", F.shiftrightunsigned(F.xxhash64("of", "c.features"), 1).alias("draw"))
    total = candidates.agg(F.sum(F.size("candidates"))).first()[0] or 0
    return rows.filter(F.col("draw") <= min(2 ** 63 - 1, 2 ** 63 * sample // max(total, 1)))


@dataclass(frozen=True)
class Model:
    """Trees as nested tuples (feature, threshold, left, right) or leaf values, their weights, and a threshold a kind."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: tuple[float, ...] = (math.inf,) * len(KINDS)

    def margin(self, values: Column) -> Column:
        def of(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(F.get(values, F.lit(feature)) <= threshold, of(left)).otherwise(of(right))

        return sum((of(t) * w for t, w in zip(self.trees, self.weights, strict=True)), F.lit(0.0))

    def redacts(self, c: Column, score: Column) -> Column:
        least = [F.lit(t) for t in self.thresholds]
        return score >= F.get(F.array(*least), c["kind"])


def _nodes(node) -> tuple | float:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return (split.featureIndex(), float(split.threshold()), _nodes(node.leftChild()), _nodes(node.rightChild()))


def rising(counts: Sequence[tuple[float, int, int]]) -> list[tuple[float, float]]:
    """Isotonic fit: (score, share that is right) that never falls, from (score, right, all) in ascending order of score."""
    blocks: list[list[float]] = []
    for score, good, n in counts:
        blocks.append([score, good, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, good, n = blocks.pop()
            blocks[-1][1] += good
            blocks[-1][2] += n
    return [(score, good / n) for score, good, n in blocks]


def threshold(counts: Sequence[tuple[float, int, int]], precision: float = PRECISION) -> float:
    """The least score at which the calibrated precision is reached; infinity if it never is."""
    return next((score for score, share in rising(counts) if share >= precision), math.inf)


def fitted(candidates: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Model:
    """Trees and thresholds, from a table of `proposed`."""
    spark = candidates.sparkSession
    taught = lessons(spark).withColumn("c", F.struct("kind", "value", "left", "right"))
    names = list(features(F.col("c")))
    rows = taught.select(F.array(*features(F.col("c")).values()).alias("features"), "right_one", F.shiftrightunsigned(F.xxhash64("id", "n"), 1).alias("draw"))
    rows = staged(rows.unionByName(corpus_lessons(candidates, sample)).coalesce(4).select(
        *[F.get("features", F.lit(n)).alias(f"f{n}") for n in range(len(names))], "features", F.col("right_one").cast("double").alias("label"),
        (F.col("draw") % 4 == 3).alias("held")))
    data = VectorAssembler(inputCols=[f"f{n}" for n in range(len(names))], outputCol="vector").transform(rows.filter("not held"))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=1, maxBins=64).fit(data)
    model = Model(tuple(_nodes(t._java_obj.rootNode()) for t in trees.trees), tuple(trees.treeWeights))
    scored = rows.filter("held").select(F.col("f0").cast("int").alias("kind"), F.round(model.margin(F.col("features")), 2).alias("score"), "label")
    table = scored.groupBy("kind", "score").agg(F.sum("label").cast("int").alias("good"), F.count("*").alias("n")).collect()  # a few hundred rows
    of = {k: sorted((r.score, r.good, r.n) for r in table if r.kind == k) for k in range(len(KINDS))}
    return Model(model.trees, model.weights, tuple(threshold(of[k], precision) for k in range(len(KINDS))))


def _chosen(candidates: Column, model: Model) -> Column:
    """Base spans, and added ones that overlap neither a base span nor an added one further left, by start."""

    def placed(c: Column) -> Column:
        score = model.margin(c["features"])
        return let(score, lambda m: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), (-m).alias("worse"), c["kind"].alias("kind"),
                                             c["base"].alias("base"), (c["base"] | model.redacts(c, m)).alias("taken")))

    def clear_of_base(s: Column) -> Column:
        ends = running(F.transform(s, lambda c: F.when(c["base"], -c["back"]).otherwise(0)), lambda a, b: F.greatest(a, b), 0)
        starts = F.reverse(running(F.reverse(F.transform(s, lambda c: F.when(c["base"], c["start"]).otherwise(2 ** 31 - 1))),
                                   lambda a, b: F.least(a, b), 2 ** 31 - 1))
        return let(ends, lambda e: let(starts, lambda b: F.filter(s, lambda c, n: c["base"] | (
            (F.get(e, n) <= c["start"]) & (F.get(b, n) >= -c["back"])))))

    def leftmost(s: Column) -> Column:
        ends = earlier(running(F.transform(s, lambda c: F.when(c["base"], 0).otherwise(-c["back"])), lambda a, b: F.greatest(a, b), 0), 0)
        return let(ends, lambda e: F.filter(s, lambda c, n: c["base"] | (F.get(e, n) <= c["start"])))

    taken = F.filter(F.array_distinct(F.sort_array(F.transform(candidates, placed))), lambda c: c["taken"])
    return let(taken, lambda t: F.when(F.size(t) == 0, t).otherwise(let(clear_of_base(t), leftmost)))


def learned(docs: DataFrame, text: str = "text") -> Model:
    """A model for these and other texts."""
    return fitted(staged(proposed(docs, [], text).filter(F.size("candidates") > 0)))


def spans_of(docs: DataFrame, kept: Sequence[Column], text: str = "text", model: Model | None = None) -> DataFrame:
    """The columns `kept` and spans, an array of kind, start, end, base and score, by kind and start. Without a model, one is
    learned from the texts."""
    found = staged(proposed(docs, kept, text))
    names = [quoted(c) for c in found.columns if c != "candidates"]
    model = model or fitted(found.select("candidates").filter(F.size("candidates") > 0))
    rows = _barrier(found, *names, _chosen(F.col("candidates"), model).alias("chosen"))
    spans = F.sort_array(F.transform("chosen", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), (-c["back"]).alias("end"),
                                                                  c["base"].alias("base"), F.round(-c["worse"], 6).alias("score"))))
    return rows.select(*names, spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(docs: DataFrame, id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id and spans of each row."""
    return spans_of(docs, [quoted(id).alias("doc_id")], text, model)


def digested(rows: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the list of base spans, the list of all, and the number of
    added ones."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    base = F.filter("spans", lambda s: s["base"])
    return rows.select("doc_id", *[of(n).alias(f"n_{k}") for n, k in enumerate(KINDS)], F.sha2(listed(base), 256).alias("base_sha256"),
                       listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def redacted(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """`docs` with each span replaced by its kind in brackets; spans that overlap become one, named after the first."""
    rows = spans_of(docs, [whole_rows(docs)], text, model)
    words, old = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), F.col("row")[text]

    def rebuilt(s: Column) -> Column:
        upto = running(F.transform(s, lambda c: c["end"]), lambda a, b: F.greatest(a, b), 0)

        def piece(c: Column, before: Column) -> Column:
            return F.when(c["start"] < before, "").otherwise(F.concat(F.substring(old, before + 1, c["start"] - before), F.get(words, c["kind"])))

        return let(upto, lambda u: F.concat(F.array_join(F.zip_with(s, earlier(u, 0), piece), ""),
                                            F.substring(old, F.element_at(u, -1) + 1, F.length(old))))

    by_start = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    new = F.when(F.size("spans") == 0, old).otherwise(let(by_start, rebuilt))
    return unpacked(rows.select(F.col("row").withField(f"`{text}`", new).alias("row")))
