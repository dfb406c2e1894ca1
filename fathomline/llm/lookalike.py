"""One form for texts that look the same.

Union-find joins code points and strings that look alike: full-width forms,
ligatures and decomposed forms by the rules of the Unicode tables, spaces and
hyphens, and the letters that Latin, Greek and Cyrillic share, transitively. Of
each class the member most frequent in the corpus represents it; texts are
rewritten greedily, longest match first, by one automaton over all other
members. Invisible characters go first, so that none hides a sequence.

Case, accents, digits, punctuation and dashes keep their difference; no two
ASCII characters are ever in one class.

Defined results: null texts have a null form and no look; the empty text is a
text; texts are rewritten whole; repeated rows are pages of their own; an empty
corpus gives classes their lowest member.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: letters that look the same in Latin, Greek and Cyrillic
SAME_LETTERS = [
    "AΑА", "BΒВ", "CСϹ", "EΕЕ", "HΗН", "IΙІӀ", "JЈͿ", "KΚК", "MΜМ", "NΝ", "OΟО", "PΡР", "SЅ", "TΤТ", "XΧХ", "YΥҮ", "ZΖ", "GԌ", "QԚ", "WԜ", "VѴ",
    "aа", "cсϲ", "dԁ", "eе", "hһ", "iі", "jјϳ", "lӏ", "oοо", "pрρ", "qԛ", "sѕ", "wԝ", "vνѵ", "xх", "yуү",
    "ΓГ", "ΠП", "ΦФ", "ΘѲ",
]
OTHER_HYPHENS = ("DOUBLE", "OBLIQUE", "DIAERESIS", "SOFT")  # hyphens of another look, or of none
LETTER_BLOCKS = ((0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000))
LIGATURES = (*(c for c in range(0x2160, 0x2180) if len(unicodedata.normalize("NFKC", chr(c))) > 1), *range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), 0x0132, 0x0133, *range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4))
VISIBLE_FORMATS = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
OTHER_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0100, 0xE01F0)}
MARKED = re.compile(r"[^\u0300-\u036f][\u0300-\u036f]+")
AT_ONCE = 1000


@lru_cache(maxsize=1)
def same_marks() -> tuple[str, ...]:
    """Spaces that don't break, and hyphens, each with the plain one, by the Unicode tables."""
    spaces = [chr(c) for c in range(0x30000) if unicodedata.decomposition(chr(c)) == "<noBreak> 0020"]
    named = ((chr(c), unicodedata.name(chr(c), "")) for c in range(0x80, 0x30000))
    hyphens = [c for c, n in named if re.search(r"\bHYPHEN\b", n) and unicodedata.category(c) in ("Pd", "Po") and not any(w in n for w in OTHER_HYPHENS)]
    return " " + "".join(spaces), "-" + "".join(hyphens)


@lru_cache(maxsize=1)
def invisible() -> re.Pattern:
    """All characters that show nothing."""
    points = sorted({c for c in range(0x30000) if unicodedata.category(chr(c)) == "Cf" and c not in VISIBLE_FORMATS} | {c for c in range(0xE0000, 0xE0200) if unicodedata.category(chr(c)) == "Cf"} | OTHER_INVISIBLE)
    spans: list[list[int]] = []
    for c in points:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]+")


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def members(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(m) for m in out.values() if len(m) > 1]


@lru_cache(maxsize=1)
def look_classes() -> tuple[tuple[tuple[str, ...], ...], tuple[str, ...]]:
    """The transitive classes, and the ligatures, whose forms are made of their letters' classes."""
    uf = Classes()
    for group in (*SAME_LETTERS, *same_marks()):
        for c in group[1:]:
            uf.union(group[0], c)
    for c in (*range(0xFF01, 0xFFEF), 0x3000):
        d = unicodedata.decomposition(chr(c)).split()
        if len(d) == 2 and d[0] in ("<wide>", "<narrow>"):
            uf.union(chr(int(d[1], 16)), chr(c))
    for c in (0x00B5, 0x2126, 0x212A, 0x212B, *(c for c in range(0x2160, 0x2180) if len(unicodedata.normalize("NFKC", chr(c))) == 1)):  # signs and numerals that are letters
        uf.union(unicodedata.normalize("NFKC", chr(c)), chr(c))
    alike: dict[str, list[str]] = {m: ms for ms in uf.members() for m in ms}
    for lo, hi in LETTER_BLOCKS:
        for c in range(lo, hi):
            parts = unicodedata.normalize("NFD", chr(c))
            if parts == chr(c):
                continue
            for base in alike.get(parts[0], [parts[0]]):  # the letter's look-alikes with the same marks
                for form in {base + parts[1:], unicodedata.normalize("NFC", base + parts[1:])}:
                    uf.union(chr(c), form)
                if len(parts) > 2:
                    for k in range(2, len(parts)):  # partly composed
                        uf.union(chr(c), unicodedata.normalize("NFC", base + parts[1:k]) + parts[k:])
    return tuple(tuple(m) for m in uf.members()), tuple(chr(c) for c in LIGATURES if unicodedata.decomposition(chr(c)).startswith("<compat>"))


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """What each member that doesn't represent its class is rewritten to; the most frequent member represents it."""
    classes, ligatures = look_classes()
    to: dict[str, str] = {}
    for members in classes:
        best = min(members, key=lambda m: (-counts.get(m, 0), len(m), m))
        to.update((m, best) for m in members if m != best)
    for c in ligatures:
        letters = "".join(chr(int(x, 16)) for x in unicodedata.decomposition(c).split()[1:])
        to[c] = "".join(to.get(x, x) for x in letters)
    return to


def count_members(texts: list[str]) -> Counter:
    """How often code points and marked letters occur."""
    found: Counter = Counter()
    for t in texts:
        found.update(t)
        if not t.isascii():
            found.update(m.group() for m in MARKED.finditer(t))
    return found


class Rewriter:
    """Greedy rewriting, by one automaton, of all strings that have a representative, the longest first.

    The automaton holds single code points and strings with combining marks. Marks
    are put in their canonical order before and after; where that makes a text
    new, it is rewritten once more. Texts in which nothing has a representative
    come out as they are.
    """

    def __init__(self, to: dict[str, str]):
        import ahocorasick

        self.plain = not any(k.isascii() for k in to)  # no ASCII text has anything to rewrite
        # what every member has: itself, or its first mark; texts without need no walk
        telling = sorted({k if len(k) == 1 else k[1] for k in to})
        self.member = re.compile("[" + "".join(map(re.escape, telling)) + "]") if telling else re.compile(r"(?!)")
        self.automaton = ahocorasick.Automaton()
        for k, v in to.items():
            self.automaton.add_word(k, (len(k), v))
        self.automaton.make_automaton()

    def form(self, text: str) -> str:
        if self.plain and text.isascii():
            return text
        text = invisible().sub("", text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = self._rewrite(text)
        if unicodedata.is_normalized("NFC", text):
            return text
        return self._rewrite(unicodedata.normalize("NFC", text))

    def _rewrite(self, text: str) -> str:
        if not self.member.search(text):
            return text
        out, at = [], 0
        for end, (size, to) in self.automaton.iter_long(text):
            start = end + 1 - size
            if start > at:
                out.append(text[at:start])
            out.append(to)
            at = end + 1
        if not at:
            return text
        out.append(text[at:])
        return "".join(out)


def corpus_counts(df: DataFrame, text: str) -> dict[str, int]:
    """Counts over the whole corpus of the members of look-alike classes (as many numbers as the classes have members)."""
    members = {m for ms in look_classes()[0] for m in ms}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                total += count_members([t for t in b.column(0).slice(lo, AT_ONCE).to_pylist() if t])
        rows = [(k, n) for k, n in total.items() if k in members]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["member", "n"])

    parts = df.select(text).mapInArrow(count, "member string, n bigint")
    return {r["member"]: r["n"] for r in parts.groupBy("member").agg(F.sum("n").alias("n")).collect()}


def _rewritten(df: DataFrame, key: str, text: str, schema: str, emit) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(representatives(corpus_counts(df, text)))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = Rewriter(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(lo, AT_ONCE)
                texts = b.column(1).to_pylist()
                yield emit(b.column(0), texts, [None if t is None else rewriter.form(t) for t in texts])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(rewrite, f"`{key}` {kind}, {schema}")


def text_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form): each text in the one form of its look."""
    return _rewritten(df, key, text, "form string", lambda keys, _, forms: pa.RecordBatch.from_arrays([keys, pa.array(forms, pa.string())], names=[key, "form"]))


def text_looks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, look, code): 128-bit digests of each text's form and of the text itself; null texts are left out."""

    def digest(t: str) -> bytes:
        return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def emit(keys: pa.Array, texts: list, forms: list) -> pa.RecordBatch:
        at = [i for i, t in enumerate(texts) if t is not None]
        codes = [digest(texts[i]) for i in at]
        looks = [c if forms[i] == texts[i] else digest(forms[i]) for i, c in zip(at, codes, strict=True)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), pa.array(looks, pa.binary()), pa.array(codes, pa.binary())], names=[key, "look", "code"])

    return _rewritten(df, key, text, "look binary, code binary", emit)


def look_pairs(looks: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b) of pages of one look and different codes; ``looks`` is read more than once, so cut its lineage first.

    Different texts of a look are paired first, as texts; then each pair of texts
    gets its pages. Copies of one text never meet, however many there are.
    """
    texts = looks.groupBy("look", "code").agg(F.count("*").alias("n"))
    mixed = texts.groupBy("look").agg(F.count("*").alias("n_texts")).filter("n_texts > 1").select("look")
    texts = texts.join(mixed, "look", "left_semi")
    pairs = texts.select("look", F.col("code").alias("code_1")).join(texts.select("look", F.col("code").alias("code_2")), "look").filter("code_1 < code_2")
    page = lambda i: looks.select("look", F.col("code").alias(f"code_{i}"), F.col(key).alias(f"k{i}"))
    out = pairs.join(page(1), ["look", "code_1"]).join(page(2), ["look", "code_2"])
    return out.filter("k1 is not null and k2 is not null and k1 <> k2").select(F.least("k1", "k2").alias(f"{key}_a"), F.greatest("k1", "k2").alias(f"{key}_b"))


def look_members(looks: DataFrame, key: str) -> DataFrame:
    """(key, class_id, n_pages, n_texts): the least key of each look, how many pages and different texts it has."""
    one = looks.groupBy("look", "code").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    per = one.groupBy("look").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_pages"), F.count("*").alias("n_texts"))
    return looks.join(per, "look").select(key, "class_id", "n_pages", "n_texts")


