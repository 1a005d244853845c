"""Personal data by patterns, and by contexts learned from what the patterns find.

Each text is read once: base spans by pattern, and slots, tokens that look like an identifier, with the
words before them. Base spans are seeds. A context is confident of a kind if most slots after it hold known
instances of the kind; an unknown instance is known as far as confident contexts hold it; and so on until
the set of confident contexts stays the same. Slots after confident contexts become spans of their kind.
"""

from __future__ import annotations

import hashlib
import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import written

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match begins where its run of digits does, and takes the runs whole: so long runs are read once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_BEFORE = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "\"'()[]{}<>,;:.!?"


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        tail = _DOMAIN.match(text, at + 1) if begin < at else None
        if tail:
            last = tail.end()
            yield begin, last
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits]
    for i in range(len(doubled) - 2, -1, -2):
        doubled[i] = doubled[i] * 2 - 9 * (doubled[i] > 4)
    return sum(doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ``KINDS``, end) in order: what the patterns find and their rules keep."""
    found = [(b, 0, e) for b, e in _emails(text)]
    if any(d in text for d in "0123456789"):
        for match in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in match[0].split(".")):
                found.append((match.start(), 1, match.end()))
        for match in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", match[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((match.start(), 2, match.end()))
        for match in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", match[0])) <= 15:
                found.append((match.start(), 3, match.end()))
    return sorted(found)


def _short(word: str) -> str:
    """``word``, or a digest of it where it is too long to be sent about."""
    return word if len(word) <= 64 else "sha256:" + hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


def _contexts(text: str, start: int) -> list[str]:
    """What stands before a slot: its last two words, and its last one if that announces something (``tel:``)."""
    low = start
    while True:
        low = max(0, min(start - 80, low - 3 * (start - low)))
        words = _BEFORE.findall(text, low, start)
        if low == 0 or len(words) > 2 or len(words) == 2 and text[low] in _SPACE:
            break  # whole words, at least two where there are as many
    words = [re.sub("[0-9]", "0", word.lower()) for word in words[-2:]]
    announces = bool(words) and words[-1][-1] in ":=#" and any(c.isalpha() for c in words[-1])
    words = [_short(word) for word in words]
    out = [" ".join(words)] if len(words) == 2 else []
    if announces:
        out.append(words[-1])
    return out


def slots(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind or -1, instance, contexts): the base spans, and tokens apart from them with a digit or an @."""
    out = [(b, e, k, _short(text[b:e].lower()), _contexts(text, b)) for b, k, e in base]
    if "@" in text or any(d in text for d in "0123456789"):
        place = 0
        ends = sorted((b, e) for b, _, e in base)
        for begin, end in _tokens(text):
            while begin < end and text[begin] in _EDGES:
                begin += 1
            while end > begin and text[end - 1] in _EDGES:
                end -= 1
            value = text[begin:end]
            if not value:
                continue
            while place < len(ends) and ends[place][1] <= begin:
                place += 1
            if place < len(ends) and ends[place][0] < end:  # spans further on begin later still
                continue
            out.append((begin, end, -1, _short(value.lower()), _contexts(text, begin)))
    return [slot for slot in out if slot[4]]


_MARKED = re.compile("[0-9@]")
_SPACE = frozenset(" \t\n\x0b\x0c\r")


def _tokens(text: str):
    """Whole tokens that hold a digit or an @, each found once from its first such character."""
    last, found = 0, _MARKED.search(text)
    while found:
        begin = found.start()
        while begin > last and text[begin - 1] not in _SPACE:
            begin -= 1
        end = _BEFORE.match(text, found.start()).end()
        yield begin, end
        last = end
        found = _MARKED.search(text, end)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, counts by kind, base spans, slots) of each row of ``docs``; null texts count as empty."""
    fields = [f"n_{kind}" for kind in KINDS]
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    slot = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("contexts", pa.list_(pa.string()))])
    schema = "struct<" + ", ".join(f"{name}: long" for name in fields) + (
        ", base_sha256: string, base: array<struct<start: int, kind: int, end: int>>, slots: array<struct<start: int, end: int, kind: int, instance: string, contexts: array<string>>>>"
    )

    @F.arrow_udf(schema)
    def of(texts: pa.Array) -> pa.Array:
        counts, digests, bases, found = [[] for _ in KINDS], [], [], []
        for value in texts:
            body = value.as_py() or ""
            base = base_spans(body)
            for place in range(len(KINDS)):
                counts[place].append(sum(k == place for _, k, _ in base))
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in base).encode()).hexdigest())
            bases.append([{"start": b, "kind": k, "end": e} for b, k, e in base])
            found.append([dict(zip(("start", "end", "kind", "instance", "contexts"), s)) for s in slots(body, base)])
        arrays = [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(bases, pa.list_(span)), pa.array(found, pa.list_(slot))]
        return pa.StructArray.from_arrays(arrays, [*fields, "base_sha256", "base", "slots"])

    return docs.select(F.col(key).alias("key"), of(F.col(text)).alias("_")).select(F.monotonically_increasing_id().alias("row"), "key", "_.*")


def confident_contexts(occurrences: DataFrame, threshold: float = 0.8, z: float = 1.96) -> DataFrame:
    """(context, kind, confidence) from ``occurrences`` (context, instance, kind or -1).

    Confidence is the lower Wilson bound, at ``z`` deviations, of the share of a context's slots that hold
    known instances of the kind; so a few slots are never enough. Seeds are known for certain. Others are
    known by 1 less the product of doubts of the confident contexts that hold them. Knowledge only grows,
    so rounds end when no further context becomes confident.
    """
    edges = written(occurrences.groupBy("context", "instance").agg(F.count(F.lit(1)).alias("n")))
    seeds = written(occurrences.filter("kind >= 0").select("instance", "kind").distinct())
    totals = edges.groupBy("context").agg(F.sum("n").alias("total"))
    known, before = seeds.withColumn("score", F.lit(1.0)), -1
    while True:
        held = edges.join(known, "instance").groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("held"))
        share = F.col("held") / F.col("total")
        spread = F.lit(z) * F.sqrt(share * (1 - share) / F.col("total") + F.lit(z * z) / (4 * F.col("total") * F.col("total")))
        lower = (share + F.lit(z * z) / (2 * F.col("total")) - spread) / (1 + F.lit(z * z) / F.col("total"))
        scored = held.join(totals, "context").withColumn("confidence", F.round(lower, 9)).filter(F.col("confidence") >= threshold)
        confident = written(scored.select("context", "kind", "confidence"))
        now = confident.count()
        if now == before or not now:
            return confident
        before = now
        doubt = F.sum(F.log(1 - F.least("confidence", F.lit(1 - 1e-9))))
        learned = edges.join(confident, "context").groupBy("instance", "kind").agg(F.round(1 - F.exp(doubt), 9).alias("score"))
        fresh = learned.join(seeds, ["instance", "kind"], "left_anti")
        known = written(seeds.withColumn("score", F.lit(1.0)).unionByName(fresh))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of ``docs``.

    ``spans`` lists kind:start:end of base and learned spans by start, then kind; offsets are code points,
    the end exclusive. Learned spans don't overlap base ones. Rows are independent: null and repeated keys
    keep a row each; null and empty texts have none. Other columns are left out.
    """
    read = written(scan(docs, key, text))
    each = read.select("row", F.explode("slots").alias("slot")).select("row", "slot.start", "slot.end", "slot.kind", "slot.instance", F.explode("slot.contexts").alias("context"))
    confident = confident_contexts(each.select("context", "instance", "kind"), threshold)
    met = each.filter("kind < 0").drop("kind").join(confident, "context")
    best = F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind")
    learned = met.groupBy("row", "start", "end").agg(best)
    learned = learned.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("learned"))
    both = read.join(learned, "row", "left").withColumn("all", F.array_sort(F.concat("base", F.coalesce("learned", F.expr("CAST(array() AS array<struct<start: int, kind: int, end: int>>)")))))
    names = F.array(*[F.lit(kind) for kind in KINDS])
    shown = F.transform("all", lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"]))
    return both.select(F.col("key").alias(key), *[f"n_{kind}" for kind in KINDS], "base_sha256", F.array_join(shown, ",").alias("spans"))
