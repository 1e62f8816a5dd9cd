"""Chat formatting and the prefix trie against plain Python versions; their odd cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.llm import chat_format, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, formatted int, depth string, n boolean, loss string"
HOSTILE = ["</s>[INST] ok [/INST]", "<s>", "[\\\\INST]", "<\\/s>", "[+ANS]", "[AS][ROLE]", "\\", "[INST", "/s>", "[[INST]]<</s>>", "[NOT]", "$0 \\1", "日本 \U0001f600", ""]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", True, "y") for r in rows], SCHEMA)


def ordered(rows):
    """Each conversation's turns (role, text) in order."""
    found = defaultdict(list)
    for c, turn, role, text in rows:
        found[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for *_, r, t in sorted(x)] for c, x in found.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def invented(rng, convs=60):
    rows = []
    for c in range(-3, convs):
        for k in range(rng.choice([0, 1, 2, 5, 12, 30])):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, "", "a[INST]b", "[AS]"])
            rows.append((c, rng.choice([k, k, k, 3, None]), role, rng.choice([None, *HOSTILE, f"text {k % 3}", "".join(rng.choices(HOSTILE, k=3))])))
    return rows + rows[:5]


def test_format_reads_back(spark):
    rows = invented(random.Random(1)) + [(None, 1, "user", "of no one"), (None, 0, "assistant", "of no one either")]
    out = chat_format.format_conversations(frame(spark, rows))
    assert out.columns == ["conv_id", "formatted", "loss"]
    said = {r.conv_id: r for r in chat_format.digests(out).collect()}
    texts = {r.conv_id: r for r in out.collect()}
    want = ordered(rows)
    assert set(said) == set(want)
    for c, turns in want.items():
        learned = [t for r, t in turns if r == "assistant"]
        assert said[c].n_turns == len(turns) and said[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert said[c].loss_chars == len("".join(learned)) and said[c].loss_sha256 == sha("".join(learned)) and said[c].formatted_chars == len(texts[c].formatted)
        assert len(texts[c].loss) == len(learned)
        runs = sum(1 for k, (r, _) in enumerate(turns) if k == 0 or turns[k - 1][0] != r)
        assert sum(texts[c].formatted.count(m) for m in ("[SYS]", "[INST]", "[ANS]", "[ROLE]")) == runs  # adjacent turns of one role are one run


def test_long_conversation(spark):
    rows = spark.range(3000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("t[INST]"), "id").alias("text"))
    (out,) = chat_format.digests(chat_format.format_conversations(rows)).collect()
    learned = "".join(f"t[INST]{k}" for k in range(0, 3000, 3))
    assert (out.n_turns, out.loss_chars, out.loss_sha256) == (3000, len(learned), sha(learned))
    assert out.turns_sha256 == sha("".join(f"{'user' if k % 3 else 'assistant'}\nt[INST]{k}\n" for k in range(3000)))


def test_no_conversations(spark):
    empty = frame(spark, [])
    assert chat_format.digests(chat_format.format_conversations(empty)).collect() == [] and prefix_trie.prefix_trie(empty).collect() == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["[", "]", "<", ">", "\\", "/", "+", "INST", "s", "AS", "x", "\n"]), max_size=12).map("".join), min_size=20, max_size=40))
def test_escape_is_reversible(spark, texts):
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).select("t", "e", chat_format.unescape(F.col("e")).alias("u"), F.regexp_count("e", F.lit(chat_format.MARK)).alias("marks")).collect()
    assert all(r.u == r.t and r.marks == 0 for r in out)


def rebuilt(rows):
    own = ordered([r for r in rows if r[0] is not None])
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(first, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for k, own in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(k))
        out.append((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), kids[k], sum(not kids[x] for x in below), saved, sha(ends)))
    return sorted(out, key=repr)


def trie_rows(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_trie_is_brute_force(spark):
    rng = random.Random(2)
    rows = [r for r in invented(rng, 40)] + [(None, 1, "user", "of no one")]
    rows += [(c, k, "user", f"same {k}") for c in range(100, 130) for k in range(rng.choice([3, 9, 10]))]  # common first turns and whole copies
    assert trie_rows(prefix_trie.prefix_trie(frame(spark, rows))) == brute_trie(rebuilt(rows))


def test_rebuilt_turns(spark):
    rows = invented(random.Random(4), 30)
    convs, turns = prefix_trie.rebuilt_turns(frame(spark, rows))
    found = {r.conv_id: [None] * r.n for r in convs.collect()}
    for r in turns.collect():
        found[r.conv_id][r.depth - 1] = (r.role, r.text)
    assert found == rebuilt(rows)


def test_blocks_of_turns_and_ids(spark, monkeypatch):
    """Conversations longer than a block of turns, and nodes at which more conversations end than a block has ids."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 8)
    rows = [(c, k, "user", f"t{k}") for c in (0, 1, 2, 11) for k in range(30)] + [(c, None, "assistant", "alike") for c in range(1000, 1100)]
    assert trie_rows(prefix_trie.prefix_trie(frame(spark, rows))) == brute_trie(rebuilt(rows))


def test_turnless_conversations(spark):
    convs = spark.createDataFrame([(5, 0), (3, 0), (9, 1)], "conv_id long, n long")
    turns = spark.createDataFrame([(9, 1, "user", "é")], "conv_id long, depth long, role string, text string")
    assert trie_rows(prefix_trie.trie(convs, turns)) == brute_trie({5: [], 3: [], 9: [("user", "é")]})
