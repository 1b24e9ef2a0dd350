"""Personal data replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, settled, stored, table

KEY = b"surrogates"
#: Entities with a second or later choice that are sent to all tasks at most; more are joined.
SENT = 200_000
#: The first choice that may be longer than what it stands for.
WIDER = 6

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
NUMBER = re.compile(
    r"(?<![\w.+-])(?:"
    r"(?P<ip>(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))(?![0-9]|\.[0-9])"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})"
    r"|(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})"
    r"|(?P<card>[0-9](?:[ -]?[0-9]){12,18})"
    r"|(?P<iban>[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)"
    r")(?![\w])"
)
#: Ranges of IPv4 addresses with a use of their own (this network, private, shared, loopback, link-local, multicast, reserved).
RANGES = [(int.from_bytes(bytes(base), "big"), 32 - bits) for base, bits in (((0, 0, 0, 0), 8), ((10, 0, 0, 0), 8), ((100, 64, 0, 0), 10), ((127, 0, 0, 0), 8), ((169, 254, 0, 0), 16), ((172, 16, 0, 0), 12), ((192, 168, 0, 0), 16), ((224, 0, 0, 0), 4), ((240, 0, 0, 0), 4))]
#: Titles before a name, by the gender they tell.
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "господин", "κύριος"), "f": ("Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "г-жа", "госпожа", "κυρία"), "n": ("Dr", "Prof")}
GENDER = {t.lower(): g for g, ts in TITLES.items() for t in ts}
NAMED = re.compile(rf"(?<!\w)({'|'.join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))})\.?[ ]([^\W\d_][^\W\d_'’-]+)(?:[ ]([^\W\d_][^\W\d_'’-]+))?")
WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+")

#: What names are spelled from, by script: consonants, vowels, and the ends of given names by gender.
SPELLING = {
    "LATIN": ("b c d f g h j k l m n p r s t v w z br dr gr kr pl st tr".split(), "a e i o u".split(), {"m": ("n", "rd", "s"), "f": ("a", "ia", "ine"), "n": ("n", "a", "e")}),
    "CYRILLIC": ("б в г д ж з к л м н п р с т ф х ч бр др гр кр ст тр".split(), "а е и о у".split(), {"m": ("н", "р", "й"), "f": ("а", "ия", "на"), "n": ("н", "а", "я")}),
    "GREEK": ("β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ ψ".split(), "α ε ι ο υ".split(), {"m": ("ος", "ης", "ας"), "f": ("α", "η", "ία"), "n": ("ος", "α", "η")}),
}


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode(), digest_size=16, key=KEY).digest(), "big")


def permuted(x: int, size: int, tweak: str) -> int:
    """A keyed bijection of 0..size-1: a Feistel network over the next even number of bits, walked until it is inside."""
    if size < 2:
        return x
    half = max(1, (max(1, (size - 1).bit_length()) + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(8):
            a, b = b, a ^ (_hash(tweak, str(size), str(r), str(b)) & mask)
        x = a << half | b
        if x < size:
            return x


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def permuted_text(text: str, tweak: str) -> str:
    """A keyed bijection of the texts with the same letters' and digits' places and all else alike."""
    radix, value, size = [], 0, 1
    for ch in text:
        own = next((c for c in _CLASSES if ch in c), None)
        radix.append(own)
        if own:
            value, size = value * len(own) + own.index(ch), size * len(own)
    value, out = permuted(value, size, tweak + "".join("." if not r else r[0] for r in radix)), []
    for ch, own in zip(reversed(text), reversed(radix)):
        if own:
            value, i = divmod(value, len(own))
            ch = own[i]
        out.append(ch)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def script(word: str) -> str:
    """The script that a name is spelled in; scripts without a spelling of their own count as Latin."""
    name = unicodedata.name(word[0], "LATIN").split(" ")[0]
    return name if name in SPELLING else "LATIN"


def _name(kind: str, norm: str, gender: str, tweak: str, wider: int) -> str:
    onset, vowel, ends = SPELLING[script(norm)]
    size, out = len(onset) * len(vowel), ""
    for turn in range((2 if kind == "given" else 3) + wider):
        h = _hash(tweak, kind, norm, gender, str(turn)) % size
        out += onset[h // len(vowel)] + vowel[h % len(vowel)]
    h = _hash(tweak, kind, norm, gender, "end")
    return out + (ends[gender][h % len(ends[gender])] if kind == "given" else onset[h % min(18, len(onset))])


def form(kind: str, norm: str) -> str:
    """What a reader tells entities apart by: names by their letters, whatever their gender and place; numbers by their digits and letters."""
    if kind in ("given", "family"):
        return "name:" + norm.partition("|")[2]
    if kind in ("email", "ip"):
        return f"{kind}:{norm}"
    return "number:" + "".join(c for c in norm if c.isalnum())


@lru_cache(1 << 16)
def surrogate(kind: str, norm: str, attempt: int) -> str:
    """What stands for an entity, in normal form: a function of the key, the entity and the number of earlier choices that collided.

    From choice WIDER on the form grows by a letter, digit or syllable each time, so that
    there is room however full a form is: names and the local parts of addresses get longer,
    numbers get more digits at their end, and IP addresses become ones of the IPv6 documentation range.
    """
    tweak, wider = f"{kind}:{attempt}", max(0, attempt - WIDER + 1)
    if wider and kind == "ip":
        h = _hash(tweak, norm)
        return "2001:db8:" + ":".join(f"{h >> s & 0xFFFF:x}" for s in range(0, 96, 16))
    if wider and kind == "email":
        norm = "a" * wider + norm
    elif wider and kind not in ("given", "family"):
        norm += "0" * wider
    if kind == "ip":
        n = _address(norm)
        base, free = _range(n)
        if free < 32:
            n = base + permuted(n - base, 1 << free, f"{tweak}:{base}")
        else:  # no range's own: walk until it is in none
            n = permuted(n, 1 << 32, tweak)
            while _range(n)[1] < 32:
                n = permuted(n, 1 << 32, tweak)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        good = luhn(norm[: len(norm) - wider])
        while True:
            norm = permuted_text(norm, tweak)
            if luhn(norm) == good:
                return norm
    if kind == "iban":
        body = permuted_text(norm[4:], tweak)
        if not _iban_ok(norm[: len(norm) - wider]):
            return norm[:2] + permuted_text(norm[2:4], tweak) + body
        return norm[:2] + f"{98 - _mod97(body + norm[:2] + '00'):02d}" + body
    if kind == "phone":
        cc, _, rest = norm.rpartition("|")
        return f"{cc}|{permuted_text(rest, tweak)}" if cc else permuted_text(rest, tweak)
    if kind == "email":
        local, _, domain = norm.partition("@")
        labels = domain.split(".")
        keep = 2 if len(labels) > 2 else 1
        # the parts are permuted together, so that different addresses stay different
        both = permuted_text(local + "@" + ".".join(labels[:-keep]), tweak)
        return both + "." + ".".join(labels[-keep:])
    if kind in ("given", "family"):
        gender, _, word = norm.partition("|")
        return f"{gender}|{_name(kind, word, gender, tweak, wider)}"
    return permuted_text(norm, tweak)


def _address(ip: str) -> int:
    return int.from_bytes(bytes(map(int, ip.split("."))), "big")


def _range(n: int) -> tuple[int, int]:
    """The first address and the free bits of the range of ``RANGES`` that ``n`` is in; of all addresses where it is in none."""
    return next(((base, free) for base, free in RANGES if n >> free == base >> free), (0, 32))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban_ok(norm: str) -> bool:
    return _mod97(norm[4:] + norm[:4]) == 1


def _refilled(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced in turn; characters that are left come at the end."""
    it = iter(chars)
    return "".join([next(it) if c.isalnum() else c for c in shape] + list(it))


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, normal form)`` of the entities of a text, in order and without overlap.

    A name with a title is of the gender that the title tells. A mention without one is the
    person named last before it, or first after it where there is none before.
    """
    found = []
    if "@" in text:
        found += [(*m.span(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    for m in NUMBER.finditer(text):
        kind, raw = m.lastgroup, m[0]
        plain = "".join(c for c in raw if c.isalnum())
        if kind == "phone":
            cc = re.match(r"\+([0-9]{1,3})(?=[ .(-])", raw)
            plain = f"+{cc[1]}|{plain[len(cc[1]) :]}" if cc else ("+|" if raw[0] == "+" else "") + plain
        found.append((*m.span(), kind, raw if kind == "ip" else plain))
    names: dict[str, list[tuple[int, str, str]]] = {}  # where titles name whom, in order
    for m in NAMED.finditer(text):
        if m[2][0].isupper():
            both = bool(m[3]) and m[3][0].isupper()
            if both:
                names.setdefault(m[2].lower(), []).append((m.start(2), "given", GENDER[m[1].lower()]))
            last = 3 if both else 2
            names.setdefault(m[last].lower(), []).append((m.start(last), "family", "n"))
    if names:  # mentions of a name without a title too
        for m in WORD.finditer(text):
            if m[0][0].isupper() and (known := names.get(m[0].lower())):
                _, kind, gender = known[max(0, bisect_right(known, m.start(), key=lambda x: x[0]) - 1)]
                found.append((*m.span(), kind, f"{gender}|{m[0].lower()}"))
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def rendered(raw: str, kind: str, chosen: str) -> str:
    """The surrogate in the format of the mention: separators, and the case of names."""
    if kind in ("given", "family"):
        word = chosen.partition("|")[2]
        return word.upper() if raw.isupper() and len(raw) > 1 else word[0].upper() + word[1:]
    if kind == "email":
        return chosen.upper() if raw.isupper() else chosen
    if kind == "ip":
        return chosen
    return _refilled(raw, "".join(c for c in chosen if c.isalnum()))


def replaced(text: str, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    out, at, kinds = [], 0, []
    for s, e, kind, norm in entities(text):
        out += [text[at:s], rendered(text[s:e], kind, surrogate(kind, norm, attempts.get((kind, norm), 0)))]
        kinds.append(kind)
        at = e
    return "".join([*out, text[at:]]), kinds


def _found(batches):
    for b in batches:
        seen = sorted({(k, n) for t in b.column(0).to_pylist() if t for _, _, k, n in entities(t)})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([n for _, n in seen], pa.string())], ["kind", "norm"])


def _chosen(batches):
    for b in batches:
        out = [form(k, surrogate(k, n, a)) for k, n, a in zip(*(b.column(i).to_pylist() for i in range(3)))]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], ["kind", "norm", "attempt", "chosen"])


def _forms(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([form(k, n) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.string())], ["chosen"])


def collisions(docs: DataFrame) -> DataFrame:
    """``(kind, norm, attempt)`` of the entities whose first choice collided: with that of another entity or with an entity of the corpus.

    Choices are compared as they are read (``form``). All entities choose; of those that
    chose alike the one with the fewest choices, then the first by kind and normal form,
    keeps its choice; the others, and those that chose an existing entity, choose again.
    Choices get longer from the WIDER-th on, so this ends after a few more rounds than that.
    """
    known = stored(docs.select("text").mapInArrow(_found, "kind string, norm string").distinct(), "entities")
    state = stored(known.withColumn("attempt", F.lit(0)).mapInArrow(_chosen, "kind string, norm string, attempt int, chosen string"), "choices")
    taken = known.mapInArrow(_forms, "chosen string").distinct().withColumn("taken", F.lit(True))
    while True:
        best = state.groupBy("chosen").agg(F.min(F.struct("attempt", "kind", "norm")).alias("keeps"), F.count("*").alias("n"))
        lost = best.where("n > 1").select("chosen", "keeps")
        both = state.join(lost, "chosen", "left").join(taken, "chosen", "left")
        again = both.where(F.col("taken") | (F.struct("attempt", "kind", "norm") != F.col("keeps")))
        again = stored(again.select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), "again")
        if not again.limit(1).count():
            out = stored(state.where("attempt > 0").select("kind", "norm", "attempt"), "collided")
            dropped(known, state, again)
            return out
        after = state.join(again.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm", "attempt", "chosen")
        after = stored(after.unionByName(again.mapInArrow(_chosen, "kind string, norm string, attempt int, chosen string")), "choices")
        dropped(state, again)
        state = after


def with_surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, kinds array<string>)``: each row's text with all entities replaced, and their kinds in order.

    One entity has one surrogate wherever it stands; different ones have different ones,
    none of which is an entity of the corpus. A null text stays null and has no kinds.
    Texts are read whole, whatever their length; an empty table gives none. Repeated rows
    are rows of their own; other columns are ignored.
    """
    docs = settled(docs.select(id_col, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    again = collisions(rows)
    few = [tuple(r) for r in again.limit(SENT + 1).collect()]
    if len(few) <= SENT:
        sent = docs.sparkSession.sparkContext.broadcast({(k, n): a for k, n, a in few})
        source = rows.withColumn("own", F.lit(None).cast("array<struct<kind:string,norm:string,attempt:int>>"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast({})

        def mentions(batches):
            for b in batches:
                found = [(i, k, n) for i, t in enumerate(b.column(1).to_pylist()) if t for k, n in {(k, n) for _, _, k, n in entities(t)}]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _, _ in found], pa.int64())), pa.array([k for _, k, _ in found], pa.string()), pa.array([n for *_, n in found], pa.string())], ["row", "kind", "norm"])

        own = rows.select("row", "text").mapInArrow(mentions, "row long, kind string, norm string").join(again, ["kind", "norm"])
        own = stored(own.groupBy("row").agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("own")), "own")
        source = rows.join(own, "row", "left").select("doc_id", "row", "text", "own")

    def run(batches):
        for b in batches:
            texts, kinds = [], []
            for text, own in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                attempts = sent.value if own is None else {(x["kind"], x["norm"]): x["attempt"] for x in own}
                t, k = replaced(text, attempts) if text else (text, [])
                texts.append(t)
                kinds.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["doc_id", "text", "kinds"])

    return source.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, kinds array<string>")


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_surrogates(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, ("email", "phone", "card", "ip", "ssn", "iban", "given", "family")), "text")
