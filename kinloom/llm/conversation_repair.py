"""Conversation structure repair by shortest paths over edits."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kinloom.llm.common import SPACE, intake
from kinloom.operators.recovery import checkpointed

#: What edits cost, by their initials; an undeleted truncated message adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults of a message, as they are told apart in a code.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: Messages whose codes are joined in the first of two steps.
RUN = 4096

_INITIALS = "suax"
#: Places in a conversation: before anything, after the system's message, the user's, the assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The place that a message of each initial leads to.
_AFTER = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: The only role, user or assistant, that may follow a place.
_NEXT = {_START: ("user", _USER), _SYSTEM: ("user", _USER), _USER: ("assistant", _ASSISTANT), _ASSISTANT: ("user", _USER)}


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(initial, place, next place, cost) of all edits of a message with this code."""
    initial, fault = _INITIALS[code // 4], code % 4
    out = [("D", q, q, DELETE) for q in range(4)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        out += [("K", q, _AFTER[q, initial], KEEP + more) for q in range(4) if (q, initial) in _AFTER]
        out += [("R", q, _NEXT[q][1], REROLE + more) for q in range(4)]
    return out


_INSERTS = [(q, _NEXT[q][1]) for q in range(4)]
_BACK = [[[(q, cost) for _, q, to, cost in _arcs(code) if to == t] for t in range(4)] for code in range(16)]
_FORWARD = [[sorted((letter, to, cost) for letter, at, to, cost in _arcs(code) if at == q) for q in range(4)] for code in range(16)]
_INSERTED = [[q for q, to in _INSERTS if to == t] for t in range(4)]
_BUCKETS = max(INSERT, REROLE + TRUNCATED, DELETE) + 1


def distances(codes: bytes) -> array:
    """Cheapest edits from (message, place) to the end, at 4 * message + place, by Dial's buckets.

    Arcs cost less than the number of buckets, so the buckets are used in turn;
    a node is settled when it is first taken from the bucket of its distance.
    """
    n = len(codes)
    far = 1 << 30
    dist = array("i", [far]) * (4 * n + 4)
    buckets: list[list[int]] = [[] for _ in range(_BUCKETS)]
    for goal in (_START, _ASSISTANT):
        dist[4 * n + goal] = 0
        buckets[0].append(4 * n + goal)
    now, waiting = 0, 2
    while waiting:
        bucket = buckets[now % _BUCKETS]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != now:
                continue
            i, place = divmod(node, 4)
            for q in _INSERTED[place]:
                at = 4 * i + q
                if dist[at] > now + INSERT:
                    dist[at] = now + INSERT
                    buckets[(now + INSERT) % _BUCKETS].append(at)
                    waiting += 1
            if i:
                for q, cost in _BACK[codes[i - 1]][place]:
                    at = node - place - 4 + q
                    if dist[at] > now + cost:
                        dist[at] = now + cost
                        buckets[(now + cost) % _BUCKETS].append(at)
                        waiting += 1
        now += 1
    return dist


def audit(codes: bytes) -> tuple[int, str]:
    """The least cost, and of the cheapest edits those whose initials are least in ASCII.

    Every initial leads from a place to one place only, so taking the least
    tight arc at each step gives the least string.
    """
    dist = distances(codes)
    i, place, out, n = 0, _START, [], len(codes)
    while i < n or place not in (_START, _ASSISTANT):
        left = dist[4 * i + place]
        options = list(_FORWARD[codes[i]][place]) if i < n else []
        to = _NEXT[place][1]
        if left == INSERT + dist[4 * i + to]:
            options.append(("I", to, INSERT))
        for letter, to, cost in sorted(options):
            if left == cost + dist[4 * (i + (letter != "I")) + to]:
                out.append(letter)
                i, place = i + (letter != "I"), to
                break
    return dist[_START], "".join(out)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    known: dict[bytes, tuple] = {}
    for batch in batches:
        rows = []
        for text in batch.column(2):
            raw = text.as_py().encode("latin-1")
            if raw not in known or len(raw) > 64:
                codes = np.frombuffer(raw, np.uint8) - 65
                faults, initials = codes % 4, codes // 4
                legal = np.isin(initials[:-1] * 4 + initials[1:], [1, 6, 9])  # su, ua, au
                found = (*(int((faults == f).sum()) for f in (BLANK, DUPLICATE, CUT)), max(len(codes) - 1, 0) - int(legal.sum()), *audit(codes.tobytes()))
                if len(raw) > 64 or len(known) > 100_000:
                    rows.append(found)
                    continue
                known[raw] = found
            rows.append(known[raw])
        arrays = [pa.array([r[k] for r in rows], pa.string() if name == "audit" else pa.int64()) for k, name in enumerate(names)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["conv", "gaps", *names])


def _letters(role: Column) -> Column:
    """Place of a role's initial in ``_INITIALS``."""
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _messages(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, at) of all messages; ``at`` rises with conversation, turn, role and text."""
    base, _ = intake(conversations, conv_col, turn_col, role_col, text_col)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    base = base.select(F.col("_w0").alias("conv"), F.col("_w1").cast("long").alias("turn"), F.coalesce("_w2", F.lit(" ")).alias("role"), F.coalesce("_w3", F.lit(" ")).alias("text"))
    ranged = checkpointed(base.repartitionByRange(*order).sortWithinPartitions(*order))
    return ranged.withColumn("at", F.monotonically_increasing_id())


def _audits(messages: DataFrame) -> DataFrame:
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    digest = [F.xxhash64(F.lit(seed), F.col("conv").isNull(), "conv", "role", F.lit(0), "text").alias(f"h{seed}") for seed in (1, 2)]
    fault = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT)
    narrow = checkpointed(messages.select("conv", "turn", "at", *digest, fault.alias("fault"), _letters(F.col("role")).alias("initial")))
    firsts = narrow.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("many")).where("many > 1").drop("many")
    marked = narrow.join(checkpointed(firsts), ["h1", "h2"], "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("at") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    code = F.chr((65 + 4 * F.col("initial") + fault).cast("long"))
    by_order = lambda col: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", col))), lambda x: x[col]), "")
    runs = marked.select("conv", "at", code.alias("code")).groupBy("conv", F.expr(f"at div {RUN}").alias("run")).agg(by_order("code").alias("codes"))
    codes = runs.withColumnRenamed("run", "at").groupBy("conv").agg(by_order("codes").alias("codes"))
    wide = "decimal(20,0)"
    spans = narrow.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(
        F.coalesce(F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count("turn"), F.lit(0)).try_cast("long").alias("gaps")
    )
    codes = codes.join(spans.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv"))).select("conv", "gaps", "codes")
    numbers = [StructField(c, LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return codes.mapInArrow(_solve, StructType([codes.schema["conv"], codes.schema["gaps"], *numbers, StructField("audit", StringType())]))


def _replayed(batches: Iterator[pa.RecordBatch], emit: str) -> Iterator[pa.RecordBatch]:
    """Messages by conversation, each behind its conversation's audit, edited as the audit says.

    ``emit``: the edited messages, or a digest of each conversation.  Of a
    conversation only the audit and the running digest are held.
    """
    conv_type = None
    conv, letters, at, place, count = None, "", 0, _START, 0
    digest, out = hashlib.sha256(), []
    begun = False

    def put(role: str, text: str) -> None:
        nonlocal count
        if emit == "messages":
            out.append((conv, count, role, text))
        else:
            digest.update(f"{chr(10) if count else ''}{role}:{text}".encode())
        count += 1

    def inserts() -> None:
        nonlocal at, place
        while letters[at : at + 1] == "I":
            role, place = _NEXT[place]
            put(role, "")
            at += 1

    def finish() -> None:
        inserts()
        if emit == "digests":
            out.append((conv, digest.hexdigest()))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out))
        kinds = [conv_type, *([pa.int64(), pa.string(), pa.string()] if emit == "messages" else [pa.string()])]
        names = ["conv", "seq", "role", "text"] if emit == "messages" else ["conv", "digest"]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        conv_type = batch.schema.field(0).type
        for one, audit_of, role, text in zip(*(batch.column(i) for i in range(4))):
            if audit_of.is_valid:
                if begun:
                    finish()
                begun, conv, letters, at, place, count, digest = True, one.as_py(), audit_of.as_py(), 0, _START, 0, hashlib.sha256()
                continue
            inserts()
            letter, role = letters[at], role.as_py()
            at += 1
            if letter == "K":
                place = _AFTER[place, role[:1]]
            elif letter == "R":
                role, place = _NEXT[place]
            if letter != "D":
                put(role, text.as_py())
        if out:
            yield batch_of()
    if begun:
        finish()
        if out:
            yield batch_of()


def _replay(messages: DataFrame, audits: DataFrame, emit: str) -> DataFrame:
    first = audits.select("conv", "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(-1).cast("long").alias("at"))
    rest = messages.select("conv", F.lit(None).cast("string").alias("audit"), "role", "text", "at")
    rows = first.unionByName(rest).repartition("conv").sortWithinPartitions("conv", "at").drop("at")
    fields = [StructField("seq", LongType()), StructField("role", StringType()), StructField("text", StringType())] if emit == "messages" else [StructField("digest", StringType())]
    return rows.mapInArrow(lambda batches: _replayed(batches, emit), StructType([messages.schema["conv"], *fields]))


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Faults and cheapest repair of every conversation, and its repaired messages.

    A conversation's messages are taken by turn, nulls first, then by role and
    text.  A message's first fault counts: blank (white space only), duplicate
    (role and text seen earlier in it), truncated (the last character that is
    not white space is none of ``.!?``).  Edits keep, rerole, delete or insert
    messages at the costs above, so that the roles' initials give
    ``(s?(ua)+)?``; blank and duplicate messages go.  Distances come from
    Dial's bucket queue, and the least string of initials from a walk over
    tight arcs.

    First frame: conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit; second: conv, seq, role, text.

    A conversation may hold any share of the rows: they are ordered by a range
    sort, earlier copies are found by minima, one byte for each message is
    gathered in two steps (as many bytes as the audit has), and its texts
    stream through a task by order.  Null role and text: one space.  Null
    conversation: one of its own.  Repeated rows are duplicates.  Empty and
    very long texts are read whole; other columns are not read; an empty table
    gives empty ones.
    """
    messages = _messages(conversations, conv_col, turn_col, role_col, text_col)
    audits = checkpointed(_audits(messages))
    return audits, _replay(messages, audits, "messages")


def repaired_digests(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The first frame of :func:`repair` with ``repaired_sha256``, the SHA-256 of all ``role:text`` joined by newlines."""
    messages = _messages(conversations, conv_col, turn_col, role_col, text_col)
    audits = checkpointed(_audits(messages))
    digests = _replay(messages, audits, "digests").select(F.col("conv").alias("_conv"), F.col("digest").alias("repaired_sha256"))
    return audits.join(digests, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with faults by crc32(``conv_id:turn``) % 20 (nulls: one space)."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name) % 20).alias("_fault")).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repaired_digests(damaged(rows))
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256(b"").hexdigest()
    # gaps may be null where they pass 64 bits; only a conversation without rows has no audit.
    zero = [F.when(F.col("audit").isNull(), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in numbers]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
