"""Variant spellings of names typed by people (problem 2).

Every name is rewritten into all its canonical forms: nicknames become the given names they stand
for, given names become initials, legal forms and trades become one spelling, token order is dropped.
Misspellings are forms too: a name with one letter left out meets its misspelling with one letter left
out. Forms are exploded and equi-joined; an agreement counts ``1 / number of identities that share
the form`` (its rarity), and only forms that point to a single identity link.

1. Fully written names give *identities* (kind, given name, surname) or (kind, core, legal form).
2. Given names that the corpus bears with several surnames are established, beside those of the nicknames.
   Long surnames one misspelling from a more frequent one are corrected; identities one misspelling apart
   are merged, the rarer spelling into the more frequent one; not if
   both given names are established ones (relatives), or trade or legal form differ (other firms).
3. Partly written names (initials, abbreviations, nicknames of several names, missing legal form) join
   the one identity that bears their form; a second given initial, where both have one, must agree.
4. A record whose names point to several identities ties these together; components are found by
   propagating the least label.

Every step after the first works on distinct identities, not records, so thousands of copies of one name
cost no more than one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.components import stars
from tesserae.sources.tables import cut

# Given names and the short forms they go by.
NICKNAMES = {
    "abigail": "abby gail abbie", "alexander": "alex al sandy xander sasha lex", "andrew": "andy drew", "anthony": "tony ant",
    "benjamin": "ben benny benji", "charles": "charlie chuck chas", "christopher": "chris kit topher", "daniel": "dan danny",
    "david": "dave davey", "deborah": "deb debbie debby", "dorothy": "dot dolly dottie dora dodie", "edward": "ed eddie ted ned teddy",
    "eleanor": "ellie nell nellie nora ella", "elizabeth": "beth liz lizzie betty eliza betsy libby lisa bess", "francisco": "paco pancho cisco kiko",
    "frederick": "fred freddie freddy", "friedrich": "fritz fred", "gabriela": "gabi gaby gabby", "gregory": "greg gregg", "harold": "hal harry",
    "henry": "harry hank hal", "ignacio": "nacho iggy", "jacqueline": "jackie jacqui", "james": "jim jimmy jamie jem",
    "jennifer": "jen jenny jenn", "johannes": "hannes hans johann", "john": "jack johnny jon", "joseph": "joe joey jo",
    "katherine": "kate kathy katie kat kit kitty kay", "konstantin": "kostya kosta", "lawrence": "larry laurie lars", "leonard": "len lenny leo",
    "margaret": "maggie meg peggy peg marge rita greta daisy madge", "matthew": "matt matty", "maximilian": "max maxi", "michael": "mike mick mickey micky mikey",
    "nicholas": "nick nico nicky nicolas", "oluwaseun": "seun olu", "patricia": "pat patty tricia trish patsy", "priyanka": "priya pri", "rebecca": "becca becky reba",
    "richard": "rich rick dick ricky richie", "robert": "bob bobby rob robbie bert", "samuel": "sam sammy", "sebastian": "seb bastian basti",
    "stephen": "steve stevie steven", "susan": "sue susie suzy suzie", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim timmy",
    "valentina": "val valya tina", "victoria": "vicky vicki tori vic vickie", "william": "bill billy will willie liam willy", "yevgenia": "zhenya genia evgenia",
}
# Spellings of legal forms and trades.
LEGAL = {
    "ltd": "ltd limited", "inc": "inc incorporated", "corp": "corp corporation", "co": "co company", "sa": "sa", "ag": "ag aktiengesellschaft",
    "gmbh": "gmbh", "llc": "llc", "plc": "plc", "bv": "bv", "srl": "srl", "oy": "oy", "kg": "kg",
    "spa": "spa", "nv": "nv", "aps": "aps", "pty": "pty", "llp": "llp", "sarl": "sarl", "oyj": "oyj", "kft": "kft", "sro": "sro", "pte": "pte",
}
TRADES = {
    "analytics": "analyt", "consulting": "cons consult", "engineering": "eng engg", "foundation": "fdn found", "institute": "inst", "international": "intl int",
    "laboratories": "labs lab", "logistics": "log logist", "manufacturing": "mfg manuf", "research": "res", "services": "svcs svc serv", "systems": "sys syst", "technologies": "tech techn",
}
_TITLES = {"dr", "prof", "phd", "msc", "mr", "mrs", "ms", "bsc", "mba", "jr", "sr"}
_GENERIC = {"team lead", "the vendor", "ops", "admin", "unknown", "reviewer", "oncall", "maintainer", "n/a", "na", "none", "tbd"}

_FORMAL = {f: {f} for f in NICKNAMES}
for _f, _short in NICKNAMES.items():
    for _s in _short.split():
        _FORMAL.setdefault(_s, set()).add(_f)
_LEGAL = {s: k for k, v in LEGAL.items() for s in v.split()}
_TRADE = {s: k for k, v in TRADES.items() for s in (k, *v.split())}
#: Sorts after every id.
_AFTER = "\U0010ffff"
#: Shortest token that may be misspelt.
TYPO_LENGTH = 4
#: Shortest surname that is corrected to a more frequent one whatever the given name.
SURNAME_LENGTH = 8
#: An alias whose bearers' own names are whole and stand for this many identities names nobody in particular.
ALIAS_IDENTITIES = 3
#: A given name borne with this many surnames is established, unless one misspelling from one borne with ten times as many.
SURNAMES, OVERSHADOWED = 3, 10

_SCHEMA = "id string, kind string, given array<string>, exact boolean, rest string, extra string, legal string, sure boolean, own boolean"


def fold(text: str) -> str:
    """Lower case without accents; letters that only look alike (digits, rn, ph) made one."""
    t = text.lower().replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("ı", "i").replace("đ", "d").replace("æ", "ae")
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return re.sub(r"(?<=[a-z])[015](?=[a-z])", lambda m: {"0": "o", "1": "i", "5": "s"}[m.group()], t)


def _alike(token: str) -> str:
    return token.replace("rn", "m").replace("ph", "f").replace("vv", "w")


def one_apart(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours (or none) makes a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def given_names(token: str) -> set[str]:
    """The given names a token may stand for: itself if established, those of a nickname, else none."""
    return _FORMAL.get(token, set()) or _FORMAL.get(re.sub(r"([aou])e", r"\1", token), set())


def _trade(token: str) -> str | None:
    if token in _TRADE:
        return _TRADE[token]
    if len(token) >= 6:
        return next((k for k in TRADES if one_apart(_alike(token), _alike(k))), None)
    return None


def organisation(name: str) -> tuple[str, str] | None:
    """(core, legal form): trade spelt out and tokens in order of the alphabet; None if it doesn't read as an organisation."""
    split = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name) if " " not in name.strip() else name
    text = fold(split).replace("gesellschaft mbh", "gmbh")
    text = re.sub(r"\b([a-z])\.\s?([a-z])\.(?=\W|$)", r"\1\2", text)
    tokens = [t for t in re.findall(r"[a-z0-9]+", text) if t not in ("the", "and", "und")]
    legal = [t for t in tokens if t in _LEGAL]
    rest = [t for t in tokens if t not in _LEGAL]
    trades = [x for t in rest if (x := _trade(t))]
    names = sorted(_alike(t) for t in rest if not _trade(t))
    if not names or not (legal or trades) or all(len(t) < 4 for t in names):
        return None
    if not trades and len(legal) < 1:
        return None
    return " ".join([*names, "/", *sorted(trades)]), _LEGAL[legal[0]] if legal else ""


def person(name: str) -> tuple[set[str], bool, str, str, bool] | None:
    """(given names or initial or abbreviation, whether spelt out, surname, second initial, whether a given name is established); None if it doesn't read so."""
    text = re.sub(r"[\[(].*?[\])]", " ", fold(name)).strip(" \t@~")
    comma = "," in text
    parts = [[t for t in re.findall(r"[a-z]+(?:'[a-z]+)?", p)] for p in text.split(",")]
    parts = [p for p in ([t for t in p if t not in _TITLES] for p in parts) if p]
    if not parts or re.search(r"[0-9]", text):
        return None
    last_first = comma and len(parts) > 1
    tokens = [*parts[1], *parts[0]] if last_first else [t for p in parts for t in p]
    if len(tokens) == 1:
        t = tokens[0]
        if len(t) >= 9 and " " not in name.strip():  # an initial glued to a surname
            return {t[0]}, False, _alike(t[1:]), "", False
        return None
    initials = [t for t in tokens if len(t) == 1]
    words = [t for t in tokens if len(t) > 1]
    if len(words) == 1:
        if not initials or len(words[0]) < 4:
            return None
        return {initials[0]}, False, _alike(words[0]), initials[1] if len(initials) > 1 else "", False
    if len(words) != 2:
        return None
    a, b = words
    if not given_names(a) and given_names(b) and not last_first:
        a, b = b, a
    second = initials[0] if initials else ""
    known = given_names(a)
    if known:
        return known, True, _alike(b), second, True
    if len(a) <= 4 and re.search(rf"\b{a}\.", text):  # an abbreviated given name
        return {a}, False, _alike(b), second, False
    return {_alike(a)}, True, _alike(b), second, False


def readings(entities: DataFrame) -> DataFrame:
    """(id, kind, given, exact, rest, extra, legal, sure, own): every reading of each record's name (``own``) and aliases.

    Null, blank and generic names have none. Records typed ``other`` are read as either kind if the name shows
    it (an established given name, a legal form or trade).
    """
    rows = entities.where(F.lower("entity_type").isin("person", "org", "other")).select("id", F.lower("entity_type").alias("t"), "name", "aliases").distinct()
    names = rows.select("id", "t", F.col("name").alias("x"), F.lit(True).alias("own"))
    aliases = rows.select("id", "t", F.explode("aliases").alias("x"), F.lit(False).alias("own"))
    both = names.unionByName(aliases).where("x is not null and trim(x) <> ''").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, t, x, own in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if x.strip().lower() in _GENERIC:
                    continue
                if t != "person" and (o := organisation(x)):
                    out.append((i, "o", [], True, o[0], "", o[1], True, own))
                elif t != "org" and (p := person(x)):
                    if t == "person" or p[4] or re.search(r"[A-Z]", x):
                        out.append((i, "p", sorted(p[0]), p[1], p[2], p[3], "", p[4], own))
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["id", "kind", "given", "exact", "rest", "extra", "legal", "sure", "own"])

    return both.select("id", "t", "x", "own").mapInArrow(run, _SCHEMA)


def established(read: DataFrame) -> DataFrame:
    """Readings with ``sure`` for given names that the corpus itself establishes, in the right order: borne with several surnames, and no misspelling of a much commoner one."""
    spelt = read.where((F.col("kind") == "p") & F.col("exact") & (F.size("given") == 1)).select(F.get("given", F.lit(0)).alias("g"), F.col("rest").alias("surname"))
    borne = cut(spelt.groupBy("g").agg(F.countDistinct("surname").alias("n")))
    near = _misspellings(borne.select(F.lit("p").alias("kind"), F.lit("").alias("g"), F.col("g").alias("rest"), F.lit("").alias("legal"), "n", F.lit(False).alias("sure")))
    better = near.select(F.col("rest").alias("g"), F.col("rest2").alias("b")).join(borne.select(F.col("g").alias("b"), F.col("n").alias("m")), "b")
    fine = borne.where(F.col("n") >= SURNAMES).join(better, "g", "left").where(F.col("m").isNull() | (F.col("m") < OVERSHADOWED * F.col("n"))).select(F.array("g").alias("given"), F.lit("p").alias("kind"), F.lit(True).alias("_known")).distinct()
    known = read.join(fine, ["kind", "given"], "left").withColumn("sure", F.col("sure") | F.coalesce("_known", F.lit(False))).drop("_known")
    # a name whose second word is an established given name, and its first is none, was typed surname first
    turned = known.join(fine.select("kind", F.get("given", F.lit(0)).alias("rest"), F.lit(True).alias("_turn")), ["kind", "rest"], "left")
    turn = F.coalesce("_turn", F.lit(False)) & F.col("exact") & ~F.col("sure") & (F.size("given") == 1)
    return turned.select(*(F.when(turn, v).otherwise(F.col(c)).alias(c) if v is not None else F.col(c) for c in read.columns for v in [{"given": F.array("rest"), "rest": F.get("given", F.lit(0)), "sure": F.lit(True)}.get(c)]))


def _deletions(identities: DataFrame) -> DataFrame:
    """(form, kind, g, rest, legal, n): identities with one letter of the given name, or of the surname or core, left out, or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms, rows = [], []
            for k, (kind, g, rest, legal) in enumerate(zip(*(b.column(c).to_pylist() for c in ("kind", "g", "rest", "legal")), strict=True)):
                mine = set()
                if len(rest) >= TYPO_LENGTH:
                    mine |= {f"{kind}|{g}|{legal}|r|{rest[:j]}{rest[j + 1:]}" for j in range(len(rest)) if rest[j].isalpha()} | {f"{kind}|{g}|{legal}|r|{rest}"}
                if kind == "p" and len(g) >= 3:
                    mine |= {f"p|{rest}||g|{g[:j]}{g[j + 1:]}" for j in range(len(g))} | {f"p|{rest}||g|{g}"}
                forms += mine
                rows += [k] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), *b.take(pa.array(rows, pa.int64())).columns], names=["form", *b.schema.names])

    return identities.mapInArrow(run, "form string, kind string, g string, rest string, legal string, n bigint, sure boolean")


def _misspellings(identities: DataFrame) -> DataFrame:
    """(kind, g, rest, legal, g2, rest2): each rarer spelling and the most frequent identity one misspelling from it."""
    forms = cut(_deletions(identities))
    a, b = forms.alias("a"), forms.alias("b")
    more = (F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & ((F.col("b.sure") & ~F.col("a.sure")) | ((F.col("b.sure") == F.col("a.sure")) & (F.concat("b.g", "b.rest") < F.concat("a.g", "a.rest")))))
    other = (F.col("a.g") != F.col("b.g")) | (F.col("a.rest") != F.col("b.rest"))
    relatives = (F.col("a.g") != F.col("b.g")) & F.col("a.sure") & F.col("b.sure")
    near = a.join(b, (F.col("a.form") == F.col("b.form")) & other & more & ~relatives)
    w = Window.partitionBy("kind", "g", "rest", "legal").orderBy(F.desc("n2"), "g2", "rest2")
    return (
        near.select(*(F.col(f"a.{c}").alias(c) for c in ("kind", "g", "rest", "legal")), F.col("b.n").alias("n2"), F.col("b.g").alias("g2"), F.col("b.rest").alias("rest2"))
        .withColumn("r", F.row_number().over(w))
        .where("r = 1")
        .select("kind", "g", "rest", "legal", "g2", "rest2")
    )


def _settle(step: DataFrame, key: list[str]) -> DataFrame:
    """Misspellings followed to their end: the spelling that one was merged into may be rarer than a third one.

    Every step leads to a more frequent spelling, so chains end; their length halves in each round.
    """
    now = cut(step)
    while True:
        second = now.select("kind", F.col("g").alias("g2"), F.col("rest").alias("rest2"), "legal", F.col("g2").alias("g3"), F.col("rest2").alias("rest3"))
        nxt = now.join(second, ["kind", "g2", "rest2", "legal"], "left")
        if nxt.where("rest3 is not null").isEmpty():
            return now.select(*key, "g2", "rest2")
        now = cut(nxt.select("kind", "g", "rest", "legal", F.coalesce("g3", "g2").alias("g2"), F.coalesce("rest3", "rest2").alias("rest2")))


def _surnames_corrected(read: DataFrame) -> DataFrame:
    """Readings whose long surname is one misspelling from a more frequent one get that: relatives spell it too."""
    borne = read.where((F.col("kind") == "p") & (F.length("rest") >= SURNAME_LENGTH)).groupBy("rest").agg(F.countDistinct("id").alias("n"))
    as_identity = borne.select(F.lit("p").alias("kind"), F.lit("").alias("g"), "rest", F.lit("").alias("legal"), "n", F.lit(False).alias("sure"))
    fixed = _settle(_misspellings(as_identity), ["kind", "rest", "legal"]).select("kind", "rest", F.col("rest2").alias("_better"))
    return read.join(fixed, ["kind", "rest"], "left").withColumn("rest", F.coalesce("_better", "rest")).select(*read.columns)


_KEY = ["kind", "g", "rest", "legal"]


def _whole() -> Column:
    """Whether a reading names its bearer in full."""
    return F.col("exact") & ((F.col("kind") == "o") & (F.col("legal") != "") | (F.col("kind") == "p") & (F.size("given") == 1))


def _settled(read: DataFrame) -> DataFrame:
    """(id, kind, g, rest, rest2, legal, extra, own, identity): whole names with misspellings merged, without aliases that name nobody in particular.

    An alias counts if it names a person with an established given name, or an organisation, or if some record
    has it as its own name; not if records of ``ALIAS_IDENTITIES`` identities bear it, however many or few they are.
    """
    full = read.where(_whole()).select("id", "kind", F.coalesce(F.get("given", F.lit(0)), F.lit("")).alias("g"), "rest", "legal", "extra", "sure", "own")
    known = cut(full.groupBy(*_KEY).agg(F.countDistinct("id").alias("n"), F.max("sure").alias("sure")))
    fixed = _settle(_misspellings(known), _KEY)
    named = F.concat_ws("|", "kind", F.coalesce("g2", "g"), F.coalesce("rest2", "rest"), "legal")
    all_ = cut(full.join(fixed, _KEY, "left").select("id", "kind", F.coalesce("g2", "g").alias("g"), "rest", F.coalesce("rest2", "rest").alias("rest2"), "legal", "extra", "sure", "own", named.alias("identity")))
    own, alias = all_.where("own"), all_.where("not own")
    bearers = alias.select("id", "identity").join(own.select("id", F.col("identity").alias("other")).distinct(), "id")
    generic = bearers.groupBy("identity").agg(F.countDistinct("other").alias("n")).where(F.col("n") >= ALIAS_IDENTITIES).select("identity")
    names = own.select("identity", F.lit(True).alias("_own")).distinct()
    kept = alias.join(generic, "identity", "left_anti").join(names, "identity", "left").where(F.col("sure") | (F.col("kind") == "o") | F.col("_own")).select(*own.columns)
    return cut(own.unionByName(kept))


def _offers(read: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, offers): the names written in part with their forms, and for each form and second initial the number of identities that bear it and the least of them."""
    spelt = settled.select("kind", "g", F.explode(F.array_distinct(F.array("rest", "rest2"))).alias("rest"), "identity").distinct()
    prefixes = F.when(F.col("kind") == "p", F.concat(F.array(F.substring("g", 1, 1), F.substring("g", 1, 2), F.substring("g", 1, 3), F.substring("g", 1, 4)), F.array("g"))).otherwise(F.array(F.lit("")))
    weak = spelt.select(F.explode(F.array_distinct(prefixes)).alias("w"), "kind", "rest", "identity").select(F.concat_ws("|", "kind", "w", "rest").alias("form"), "identity").distinct()
    seconds = settled.where("extra <> ''").groupBy("identity").agg(F.collect_set("extra").alias("seconds"))  # at most one for each letter
    bearers = weak.join(seconds, "identity", "left")
    partly = read.where(~_whole()).withColumn("w", F.explode(F.when(F.col("kind") == "p", F.col("given")).otherwise(F.array(F.lit("")))))
    asked = partly.select("id", "kind", "extra", "rest", "given", "own", "sure", F.concat_ws("|", "kind", "w", "rest").alias("form"))
    agrees = (F.col("extra") == "") | F.col("seconds").isNull() | F.array_contains("seconds", F.col("extra"))
    offers = asked.select("form", "extra").distinct().join(bearers, "form").where(agrees).groupBy("form", "extra").agg(F.countDistinct("identity").alias("n"), F.min("identity").alias("one"))
    return asked, offers


def _read(entities: DataFrame) -> DataFrame:
    return cut(_surnames_corrected(cut(established(cut(readings(entities))))))


def rarities(entities: DataFrame) -> DataFrame:
    """(id, form, identities, score): each name written in part with the form it was rewritten to, how many identities bear that, and its rarity 1 / identities."""
    read = _read(entities)
    asked, offers = _offers(read, _settled(read))
    return asked.join(offers, ["form", "extra"]).select("id", "form", F.col("n").alias("identities"), F.round(1 / F.col("n"), 6).alias("score")).distinct()


def identities_of(entities: DataFrame) -> DataFrame:
    """(id, identity): the identities that each record's names point to."""
    read = _read(entities)
    settled = _settled(read)
    asked, offers = _offers(read, settled)
    reading = ["id", "kind", "rest", "extra", "given"]
    # of all forms of a name one identity must come out: the forms' rarities are 1 and they agree
    met = asked.join(offers, ["form", "extra"]).groupBy(*reading).agg(F.max("n").alias("n"), F.min("one").alias("one"), F.max("one").alias("other"))
    score = F.when(F.col("one") == F.col("other"), 1.0 / F.col("n")).otherwise(0.0)
    joined = met.where(score > 0.5).select("id", F.col("one").alias("identity"))
    unmet = asked.join(met.select(*reading), reading, "left_anti")
    part = unmet.select("id", "own", F.concat_ws("|", F.lit("part"), "kind", F.array_join("given", "+"), "rest", "extra").alias("identity"))
    alone = part.join(part.where("own").select("identity").distinct(), "identity", "left_semi").select("id", "identity")
    return settled.select("id", "identity").unionByName(joined).unionByName(alone).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): records tied together by shared identities; component is its least id.

    Records and identities are the two kinds of nodes of one graph; identities are named so that they sort
    after all records.
    """
    links = cut(links)
    joined = stars(links.select(F.col("id").alias("b"), F.concat(F.lit(_AFTER), "identity").alias("a")))
    return joined.where(~F.startswith("node", F.lit(_AFTER))).select(F.col("node").alias("id"), F.col("root").alias("component"))


def variants(entities: DataFrame) -> DataFrame:
    """(id, component): every record with a readable name and the person or organisation it stands for."""
    return components(identities_of(entities))


def pairs(members: DataFrame) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: all pairs of records of a component."""
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, (F.col("a.component") == F.col("b.component")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
