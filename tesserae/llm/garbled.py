"""Garbled text from wrong character encoding (problem 8).

Garbled sequences are precomputed for all pairs of a true and a wrong encoding and matched by one
multi-pattern automaton; only matched spans are replaced, so mixed correct text stays untouched.

* *Characters.* Every character of the single-byte encodings and of the Japanese rows, whether the corpus holds it
  or not, written in UTF-8 (Japanese ones also in their own encodings) and read in every wrong encoding,
  gives a sequence of two or more characters. This automaton is fixed; a worker builds it once.
* *Words.* Between two single-byte encodings a garbled character looks like any other, and a text that lost its
  control characters has gaps. Here every word of the corpus is read back under all pairs of encodings and joined
  with the words there are: a pair of words, one of which is the other one garbled, is a pattern. Counts
  never admit a pattern; they rule out those in which the garbled form is a word of its own.

How certain a sequence is: one that correct text of no language can have (letters of no one alphabet, signs or
capitals within a word) is certain. One that could be correct counts where its document has a certain one
of the same pair of encodings (characters), or another garbled word of that pair (words).
Replacement characters and C1 control characters are evidence by themselves. A match counts as a
mention, not as garbling, if it stands alone between quotes or backticks, inside an identifier, or
before its code point in parentheses. Texts of several rounds of garbling are restored round by round.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.tables import cut
from tesserae.sources.worker import kept

#: A form in fewer documents than this is no usage of its own where its original is in that many.
LEAST = 3
#: A garbled form in more than this part of its original's documents is not certain by its rarity: of
#: sequences made of UTF-8 or Japanese bytes, which correct text hardly has, and of all others.
AMBIGUOUS_BYTES, AMBIGUOUS = 0.3, 0.03
#: Rounds of garbling undone; text that is garbled still is reported as incomplete.
ROUNDS = 12
#: What a sequence shows: garbling by itself; together with another such word; together with a certain sequence.
CERTAIN, WITH_ANOTHER, WITH_CERTAIN = 2, 1, 0

# The encodings considered, by what they are good for.
WESTERN = ("cp1252", "iso8859-15", "mac-roman", "cp437", "cp850")
CENTRAL = ("cp1250", "iso8859-2", "cp852", "mac-latin2")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic")
JAPANESE = ("cp932", "euc-jp")
WRONG = ("cp1252", "latin-1", "cp1254", "cp1257", *WESTERN[1:], *CENTRAL, *CYRILLIC)
OTHERS = ("cp1253", "iso8859-7", "cp1254", "cp1257", "cp1255", "cp1256", "cp1258", "iso8859-4", "iso8859-10", "iso8859-16")
TRUE = ("utf-8", *WESTERN, *CENTRAL, *CYRILLIC, "cp1253", "cp1254", "cp1257")

_CHUNK = re.compile(r"([^\s\x00-\x1f!-/:-@\[-`{-~]+)(?=( [a-z]{2,}\b)?)")
_UNBROKEN = re.compile(r"[^\x00-/:-@\[-`{-~]+")
_JAPANESE = re.compile("[ぁ-ヿ一-鿿]")
_C1 = re.compile(r"[\x80-\x84\x86-\x9f]")
_SIGNS = "°€£§µ²³½±×≈→•–—…©®™≤≥"
_OTHER_SCRIPTS = frozenset("абвгдежзийклмнопрстуфхцчшщъыьэюяёєіїґўђјљњћџѓќѕαβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ")
#: Letters beyond ASCII of one language each.
_ALPHABETS = tuple(
    frozenset(a)
    for a in (
        "äöüßé", "àâæçèéêëîïôœùûüÿ", "áéíñóúü", "áâãàçéêíóôõúü", "ąćęłńóśźż", "áčďéěíňóřšťúůýž", "áäčďéíĺľňóôŕšťúýž", "áéíóöőúüű", "ăâîșțşţ", "çğıöşüâîû", "åäöé", "æøåéô", "áðéíóúýþæö",
        "àèéìíîòóùú", "áéèêëïóöü", "čćđšž", "çë", "ąčęėįšųūž", "āčēģīķļņšūž", "äõöüšž", "àçèéíïòóúü",
        "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "абвгдежзийклмнопрстуфхцчшщьюяєіїґ", "абвгдежзійклмнопрстуфхцчшыьэюяёў", "абвгдежзијклмнопрстуфхцчшђљњћџѓќѕ", "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ",
    )
)
#: Blocks of characters that no single-byte encoding has whole: Latin, Greek, Cyrillic, punctuation and signs, full-width forms, pictographs.
_BLOCKS = ((0x100, 0x180), (0x386, 0x3D0), (0x400, 0x460), (0x490, 0x494), (0x2010, 0x2060), (0x20A0, 0x20C0), (0x2100, 0x2C00), (0xFE0F, 0xFE10), (0xFF00, 0xFFF0), (0x1F300, 0x1FB00))
#: Words of a single letter beyond ASCII, and of Russian.
_ONE_LETTER, _ONE_LETTER_RUSSIAN = frozenset("àáäåæèéêíìóòôöøúùü"), frozenset("аивкосуяжбэ")
#: A garbled word's original, whether certain by itself, and the encoding pairs.
Pattern = tuple[str, bool, frozenset[tuple[str, str]]]
_QUOTES = "«»„“”‘’‚‹›…–—¿¡、。・「」"
_INNER = re.compile(f"[{_QUOTES}]+")
_MENTION = (("`", "`"), ("'", "'"), ('"', '"'), ("‘", "’"), ("“", "”"), ("«", "»"), ("„", "“"))


def misread(text: str, true: str, wrong: str) -> str | None:
    """``text`` written in ``true`` and read in ``wrong``; bytes that ``wrong`` lacks stay as control characters; None if it can't be written."""
    try:
        data = text.encode(true)
    except UnicodeEncodeError:
        return None
    if wrong in JAPANESE:
        return data.decode(wrong, "replace")
    return "".join(_char(b, wrong) for b in data)


def _char(b: int, wrong: str) -> str:
    try:
        return bytes([b]).decode(wrong)
    except UnicodeDecodeError:
        return chr(b)


def chunks(text: str) -> set[str]:
    """Words beyond ASCII, and single signs with the lower-case word after them."""
    found = set()
    for word, after in _CHUNK.findall(text):
        if word.isascii() or any("0" <= c <= "9" for c in word) or any("぀" <= c <= "鿿" for c in word):
            continue
        if len(word) > 1:
            found.add(word)
            for core in _INNER.split(word):
                if len(core) > 1 and not core.isascii():
                    found.add(core)
        elif after:
            found.add(word + after)
    return found


def unbroken(text: str) -> set[str]:
    """Words that hold a blank beyond ASCII, as a garbled letter may be."""
    return {w for w in _UNBROKEN.findall(text) if ("\xa0" in w or "\x85" in w) and len(w) > 1} if "\xa0" in text or "\x85" in text else set()


def frequencies(documents: DataFrame) -> DataFrame:
    """(seq, n): in how many documents each character beyond ASCII and each chunk is, over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: Counter = Counter()
            for t in b.column(0).to_pylist():
                if t and not t.isascii():
                    total.update({c for c in t if c > "\x9f"} | chunks(t) | unbroken(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["seq", "n"])

    return documents.select("text").mapInArrow(run, "seq string, n bigint").groupBy("seq").agg(F.sum("n").alias("n"))


def natural(seq: str) -> int:
    """``_natural``, remembered by the worker."""
    known = kept(("natural",), dict)
    if seq not in known:
        if len(known) > 200_000:
            known.clear()
        known[seq] = _natural(seq)
    return known[seq]


def _natural(seq: str) -> int:
    """Whether correct text of some language may be written so: 2 yes, 1 only in capitals, 0 no. By letters and case alone, not by any count."""
    ranks = [2]
    marks = "".join(c for c in set(seq) if unicodedata.category(c)[0] == "P")
    for piece in re.split("[ ’'‑-]", seq.strip(marks)):
        letters = [c for c in piece if c.isalpha()]
        if len(letters) < len(piece) and (letters or any(c not in _SIGNS for c in piece)) and not re.fullmatch(f"[{_SIGNS}][A-Za-z]{{1,2}}", piece):
            return 0
        beyond = {c for c in piece.lower() if c > "\x7f" and c.isalpha()}
        if beyond and not any(beyond <= a for a in _ALPHABETS):
            return 0
        word = "".join(letters)
        if beyond & _OTHER_SCRIPTS and any(c.isascii() for c in word):
            return 0
        if len(word) > 1 and word.isupper():
            ranks.append(1)
        elif word[1:] != word[1:].lower():
            return 0
    return min(ranks)


def repertoire() -> list[str]:
    """The characters beyond ASCII of all encodings considered, control characters included: what a first round of garbling makes is garbled once more."""
    single = {c for e in (*WRONG, *OTHERS) for b in range(128, 256) if (c := _char(b, e)) != "�"} | {chr(c) for c in range(0x80, 0x100)}
    rows = {(a, b) for a in range(0xA1, 0xFF) for b in range(0xA1, 0xFF)}
    japanese = {c for a, b in rows if len(c := bytes([a, b]).decode("euc-jp", "ignore")) == 1}
    blocks = {chr(c) for a, b in _BLOCKS for c in range(a, b) if unicodedata.category(chr(c)) != "Cn"}
    return sorted(single | japanese | blocks)


def fixed_automaton() -> ahocorasick.Automaton:
    """All garbled characters: (form, ((original, encoding pairs), ...), whether Japanese only), likelier pairs first."""
    found: dict[str, dict[str, list[tuple[str, str]]]] = {}

    def add(form: str | None, x: str, pair: tuple[str, str]) -> None:
        if form and form != x and len(form) > 1 and not form.isascii() and "�" not in form:
            found.setdefault(form, {}).setdefault(x, []).append(pair)

    chars = repertoire()
    data = [x.encode() for x in chars]
    for wrong in WRONG:
        t = [_char(b, wrong) for b in range(256)]
        for x, d in zip(chars, data, strict=True):
            form = "".join([t[b] for b in d])
            add(form, x, ("utf-8", wrong))
            if x in _SIGNS:  # the form may have lost its control characters
                add(_C1.sub("", form), x, ("utf-8", wrong))
    for x in chars:
        add(misread(x, "utf-8", "cp932"), x, ("utf-8", "cp932"))
    for x in chars:
        if "　" <= x <= "鿿":
            for true in JAPANESE:
                for wrong in ("latin-1", "cp1252"):
                    add(misread(x, true, wrong), x, (true, wrong))
    a = ahocorasick.Automaton()
    for form, originals in found.items():
        japanese = all(p[0] != "utf-8" for pairs in originals.values() for p in pairs)
        a.add_word(form, (form, tuple((x, tuple(pairs)) for x, pairs in originals.items()), japanese))
    for c in [*range(0x80, 0x85), *range(0x86, 0xA0), 0xFFFD]:  # evidence without a known original
        if not a.exists(chr(c)):
            a.add_word(chr(c), (chr(c), ((None, ()),), False))
    a.make_automaton()
    return a


def level(form: str, original: str | None, japanese: bool, text: str, lo: int, hi: int) -> int:
    """What a garbled character at text[lo:hi] shows: a form that correct text may have is certain only within a word that it can't have."""
    if form[0] in "–—" and not any(c.isalpha() for c in form):  # a dash before a sign
        return WITH_CERTAIN
    if japanese:
        return CERTAIN if natural(form) == 0 and not any(c.isascii() for c in form) else WITH_CERTAIN
    if original is None or natural(form) < 2 or len(form) > 2 and not form.isalpha():
        return CERTAIN
    while lo > 0 and text[lo - 1].isalnum():
        lo -= 1
    while hi < len(text) and text[hi].isalnum():
        hi += 1
    word = "".join(c for c in text[lo:hi] if c.isalnum())
    lone = len(word) == 1 and word.lower() not in _ONE_LETTER or word == form and original.lower() in _ONE_LETTER_RUSSIAN
    return CERTAIN if lone or form[-1] in "‚„" or natural(text[lo:hi]) == 0 else WITH_CERTAIN


def certain(garbled: str, original: str, n_garbled: int, n_original: int, ambiguous: float) -> bool | None:
    """Whether the form alone shows garbling; False if its document must bear it out; None if it never does.

    A form that correct text can't have, while it can have the original, shows it however often it occurs. A
    form in fewer than ``LEAST`` documents, whose original is in more, is no usage of its own.
    """
    if n_garbled <= ambiguous * n_original or n_garbled < LEAST <= n_original:
        return True
    a, b = natural(garbled), natural(original)
    if a < b:
        return True
    return False if a == b and n_garbled < n_original else None


def _mentioned(text: str, lo: int, hi: int) -> bool:
    """Whether text[lo:hi] stands there on purpose."""
    before, after = text[lo - 1 : lo], text[hi : hi + 1]
    if (before, after) in _MENTION:
        return True
    if before == "_" and after == "_":
        return True
    return text[hi : hi + 4] == " (U+"


def _japanese_word(text: str, lo: int, hi: int, pairs: tuple[tuple[str, str], ...]) -> bool:
    """Whether what stands between blanks around text[lo:hi] is Japanese from end to end when read back."""
    while lo > 0 and not text[lo - 1].isspace():
        lo -= 1
    while hi < len(text) and not text[hi].isspace():
        hi += 1
    for true, wrong in pairs:
        try:
            back = text[lo:hi].encode(wrong).decode(true)
        except UnicodeError:
            continue
        if all(_JAPANESE.match(c) for c in back):
            return True
    return False


def spans(text: str, a: ahocorasick.Automaton, own: dict[str, Pattern] | None = None, usual: dict[str, int] | None = None) -> list[tuple[int, int, str | None]]:
    """Non-overlapping garbled spans (start, end, original or None), longest first among those that start together.

    ``own``: garbled words of the document; ``usual``: in how many documents of the corpus characters are.
    """
    usual = usual or {}
    met = []
    chars = [(end + 1 - len(form), end + 1, form, originals, japanese) for end, (form, originals, japanese) in a.iter(text)]
    # Japanese text has kana, more of it than what else may have been made of UTF-8, unless the text is Japanese elsewhere
    kana = Counter(p for c in chars for x, pairs in c[3] if x and "ぁ" <= x <= "ヿ" for p in pairs if p[0] != "utf-8")
    unicode = sum(c[3][0][1][0][0] == "utf-8" for c in chars if c[3][0][1])
    alone = not unicode and bool(_JAPANESE.search(text))
    times = Counter(p for c in chars for _, pairs in c[3] for p in pairs)
    for lo, hi, form, originals, japanese in chars:
        if not alone and originals[0][1]:
            originals = [o for o in originals if o[1][0][0] == "utf-8" or any(kana[p] >= max(3, 1.5 * unicode) for p in o[1])]
            if not originals:
                continue
        # of several readings one that the corpus has at all, under the encoding pair that the document shows most
        original, pairs = originals[0] if len(originals) == 1 else max(originals, key=lambda o: (usual.get(o[0], 0) > 0, max(times[p] for p in o[1]), usual.get(o[0], 0)))
        met.append((lo, -hi, original, CERTAIN if alone and japanese and _japanese_word(text, lo, hi, pairs) else level(form, original, japanese, text, lo, hi), pairs))
    for form, (original, sure, pairs) in (own or {}).items():
        for m in re.finditer(re.escape(form), text):
            lo, hi = m.span()
            if not (text[lo - 1 : lo].isalnum() or text[hi : hi + 1].isalnum()):
                met.append((lo, -hi, original, CERTAIN if sure else WITH_ANOTHER, pairs))
    certain_pairs = {p for m in met if m[3] == CERTAIN for p in m[4]}
    under: defaultdict[tuple[str, str], set[str]] = defaultdict(set)
    for _, _, original, rank, pairs in met:
        if original is not None and rank != WITH_CERTAIN:
            for p in pairs:
                under[p].add(original.casefold())
    shows = lambda m: m[3] == CERTAIN or (any(len(under[p]) > 1 for p in m[4]) if m[3] == WITH_ANOTHER else not certain_pairs.isdisjoint(m[4]))
    hits = sorted((m[:3] for m in met if shows(m)), key=lambda h: h[:2])
    out, through = [], 0
    for lo, hi, original in hits:
        if lo >= through:
            out.append((lo, -hi, original))
            through = -hi
    # neighbours of one garbled run are judged together
    merged: list[list] = []
    for s in out:
        if merged and merged[-1][-1][1] == s[0]:
            merged[-1].append(s)
        else:
            merged.append([s])
    return [s for run in merged if not _mentioned(text, run[0][0], run[-1][1]) for s in run]


def restore(text: str, a: ahocorasick.Automaton, own: dict[str, Pattern] | None = None, usual: dict[str, int] | None = None) -> tuple[str, int, bool]:
    """(text with the garbled spans replaced, number of spans in the first round, whether nothing garbled is left)."""
    found = spans(text, a, own, usual)
    first = len(found)
    for _ in range(ROUNDS):
        known = [s for s in found if s[2] is not None]
        if not known:
            break
        parts, at = [], 0
        for lo, hi, original in known:
            parts += [text[at:lo], original]
            at = hi
        text = "".join([*parts, text[at:]])
        found = spans(text, a, own, usual)
    return text, first, not found


def _read_back() -> tuple[dict[str, dict[str, int]], dict[str, dict[int, str]]]:
    """Of each wrong encoding, the byte of each character, and the characters of the bytes."""
    chars = {w: {b: _char(b, w) for b in range(256)} for w in dict.fromkeys((*WRONG, "latin-1"))}
    return {w: {c: b for b, c in t.items()} for w, t in chars.items()}, chars


def _worded(x: str) -> bool:
    """Whether a reading may be a correct word: letters in an order of capitals that words have. Cheap; ``natural`` looks closer."""
    bare = x.strip(_QUOTES).replace("’", "").replace("-", "").replace("'", "").replace(" ", "")
    return bare.isalpha() and (bare[1:] == bare[1:].lower() or bare.isupper()) or len(bare) < len(x) and not bare.strip(_SIGNS)


def word_patterns(counted: DataFrame) -> DataFrame:
    """(garbled, original, sure, pairs): words of the corpus that are others of its words garbled; ``counted`` (seq, n) are all words.

    Every word is read back under all pairs of encodings, and what comes out is joined with the words there are.
    Forms that lost their control characters can't be read back, so they are made from the originals.
    """
    words = counted.where(F.length("seq") > 1)
    kind = "garbled string, original string, true string, wrong string"

    def batch(rows: list[tuple[str, str, str, str]]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=["garbled", "original", "true", "wrong"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_of, _ = _read_back()
        for b in batches:
            rows: list[tuple[str, str, str, str]] = []
            for y in b.column(0).to_pylist():
                for wrong, table in byte_of.items():
                    try:
                        data = bytes([table[c] for c in y])
                    except KeyError:
                        continue
                    for true in TRUE:
                        if true == wrong:
                            continue
                        try:
                            x = data.decode(true)
                        except UnicodeDecodeError:
                            continue
                        if x != y and not x.isascii() and not _C1.search(x) and (true == "utf-8" or _worded(x)):
                            rows.append((y, x, true, wrong))
                if len(rows) > 50_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, chars = _read_back()
        lost = {w: frozenset(b for b, c in t.items() if _C1.match(c)) for w, t in chars.items()}
        for b in batches:
            rows: list[tuple[str, str, str, str]] = []
            for x in b.column(0).to_pylist():
                if _C1.search(x) or not _worded(x):
                    continue
                for true in TRUE:
                    try:
                        data = x.encode(true)
                    except UnicodeEncodeError:
                        continue
                    for wrong, table in chars.items():
                        if true != wrong and not lost[wrong].isdisjoint(data):
                            g = "".join(table[k] for k in data if k not in lost[wrong])
                            if len(g) > 1 and not g.isascii() and g != x:
                                rows.append((g, x, true, wrong))
                if len(rows) > 50_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    # little data and much work a row: spread over all cores, which sizes in bytes would not do
    spread = words.select("seq").repartition(4 * counted.sparkSession.sparkContext.defaultParallelism)
    named = lambda c: words.select(F.col("seq").alias(c), F.col("n").alias(f"n_{c}"))
    decoded = spread.mapInArrow(back, kind).join(named("original"), "original").join(named("garbled"), "garbled")
    without = spread.mapInArrow(stripped, kind).join(named("garbled"), "garbled").join(named("original"), "original")
    cols = ["garbled", "original", "true", "wrong", "n_garbled", "n_original"]
    met = decoded.select(*cols, F.lit(False).alias("part")).unionByName(without.select(*cols, F.lit(True).alias("part")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            sure = [certain(r["garbled"], r["original"], r["n_garbled"], r["n_original"], AMBIGUOUS_BYTES if r["true"] == "utf-8" and not r["part"] else AMBIGUOUS) for r in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols[:4]), b.column("n_original"), pa.array(sure, pa.bool_())], names=[*cols[:4], "n_original", "sure"])

    judged = met.mapInArrow(judge, kind + ", n_original bigint, sure boolean").where("sure is not null")
    each = judged.groupBy("garbled", "original").agg(F.max("sure").alias("sure"), F.max("n_original").alias("n"), F.collect_set(F.struct("true", "wrong")).alias("pairs"))
    best = each.groupBy("garbled").agg(F.max(F.struct("sure", "n", "original", "pairs")).alias("m"))
    return best.select("garbled", "m.original", "m.sure", "m.pairs")


def words_in(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, own): the garbled words that each document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text and not text.isascii():
                    mine = chunks(text) | unbroken(text)
                    ids += [doc] * len(mine)
                    found += mine
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["doc_id", "garbled"])

    held = documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, garbled string").join(patterns, "garbled")
    return held.groupBy("doc_id").agg(F.collect_set(F.struct("garbled", "original", "sure", "pairs")).alias("own"))


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, spans, restored, complete) of every affected document.

    ``restored`` is the text with what could be restored, ``complete`` whether nothing garbled is left in it.
    Null, empty and pure ASCII texts are never affected; copies are each reported.
    """
    beyond = documents.select("doc_id", "text").where(F.col("text").rlike(r"[^\x00-\x7f]"))
    counted = cut(frequencies(beyond))
    own = words_in(beyond, word_patterns(counted))
    usual = documents.sparkSession.sparkContext.broadcast({r.seq: r.n for r in counted.where(F.length("seq") == 1).collect()})  # a row for each code point in use

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = kept(("garbled characters", 1), fixed_automaton)
        for b in batches:
            rows = []
            for doc, text, words in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                mine = {r["garbled"]: (r["original"], r["sure"], frozenset((p["true"], p["wrong"]) for p in r["pairs"])) for r in words or ()}
                fixed, n, whole = restore(text, a, mine, usual.value)
                if n:
                    rows.append((doc, n, fixed, whole))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "spans", "restored", "complete"])

    return beyond.join(own, "doc_id", "left").mapInArrow(run, "doc_id bigint, spans int, restored string, complete boolean")
