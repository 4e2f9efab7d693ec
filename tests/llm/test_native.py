"""op1, op3, op4, op6, op7: contracts, brute force and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from docdelta.llm import chat, decontaminate, pii, quality_rules, shards
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows of (doc_id, text), with clashing extra columns."""
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in ("words", "n", "hits", "fp", "key", "range", "toks", "found", "row", "body", "turns", "id"):
        df = df.withColumn(name, F.lit("x"))
    return df


# ---- chat -----------------------------------------------------------------


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("parts", F.lit(2))


def test_chat_round_trip_and_loss(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "[ROLE]x[/ROLE]", "", "<s><s>", "a\nb", "é🎉" * 3, None]
    rng = random.Random(1)
    rows, want = [], {}
    for c in range(30):
        turns = [(rng.choice(["user", "assistant", "system", "[INST]", None]), rng.choice(hard)) for _ in range(rng.randint(1, 6))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
        said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(chat.expand(talk(spark, rows))).collect()}
    assert got == want


def test_chat_examples_have_context_and_one_target(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "s")]
    ex = {r.n_context: r for r in chat.expand(talk(spark, rows)).collect()}
    assert sorted(ex) == [1, 3, 4] and [ex[k].trainable for k in sorted(ex)] == [True, True, False]
    assert ex[3].text[ex[3].loss_start : ex[3].loss_end] == "b" and ex[3].text.startswith(ex[1].text)
    assert ex[4].complete and ex[4].loss_start == ex[4].loss_end


def test_chat_empty_repeated_and_null_keys(spark):
    assert chat.digest(chat.expand(talk(spark, []))).count() == 0
    rows = [(None, None, "user", "x"), (None, 1, "assistant", "y"), (5, 0, "assistant", "z"), (5, 0, "assistant", "z")]
    got = {r.conv_id: r for r in chat.digest(chat.expand(talk(spark, rows))).collect()}
    assert got[None].n_turns == 2 and got[5].n_turns == 2 and got[5].loss_chars == 2


# ---- shards ---------------------------------------------------------------


@pytest.mark.parametrize("case", ["spread", "hot", "same", "one"])
def test_shards_are_gapless_and_near_equal(spark, case):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 60)) for i in range(1500)]
    if case == "hot":
        rows = [(7 if i % 3 == 0 else i, t) for i, t in rows]
    if case == "same":
        rows = [(7, "same")] * 900
    if case == "one":
        rows = [(1, "x" * 5000), (None, None)]
    got = shards.assign(docs(spark, rows), shards=8).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by = {s: [r for r in got if r.shard == s] for s in {r.shard for r in got}}
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 8) for i, t in rows)
    if case != "one":
        sizes = [sum(r.size for r in rs) for rs in by.values()]
        assert len(by) == 8 and max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
        assert max(Counter(r.range for r in got).values()) < len(got) / 4  # no range holds the hot key alone


def test_shards_size_and_checksum(spark):
    rows = [(1, "aé🎉"), (2, None), (3, "")]
    got = {r.doc_id: r for r in shards.assign(docs(spark, rows), shards=3).collect()}
    assert (got[1].size, got[1].text_crc32) == (15, zlib.crc32("aé🎉".encode())) and got[2].size == got[3].size == 8 and got[2].text_crc32 == 0
    assert shards.assign(docs(spark, []), shards=3).count() == 0


# ---- PII ------------------------------------------------------------------

PRIVATE = [
    (1, "Mail Und.34@mail7.example.com or und.34@mail7.example.com, host 97.51.17.173."),
    (2, 'card 4111 1111 1111 1111 and 4111111111111111; token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'),
    (3, "call +1 (017) 555-7713 or +49 30 1234 5678; SSN 123-45-6789; DE89 3704 0044 0532 0130 00"),
    (4, "Mrs. Jennifer Miller met Александр Петров and Dr Smith; Jennifer Miller left."),
    (5, "Nothing here: version 2.0, 3.14, 17 days, a=b."),
    (6, ""),
    (7, None),
    (None, "x 97.51.17.173 y"),
]


def replaced(spark, rows, **how):
    return [(r.doc_id, r.text) for r in pii.replace(docs(spark, rows), **({"key": "k1"} | how)).collect()]


def test_pii_is_gone_and_clean_text_stays(spark):
    got = dict(replaced(spark, PRIVATE))
    for secret in ["und.34", "Und.34", "97.51.17.173", "4111", "24be6443", "017) 555", "123-45-6789", "3704 0044", "Miller", "Петров", "Smith"]:
        assert not any(secret in (t or "") for t in got.values()), secret
    assert got[5] == PRIVATE[4][1] and got[6] == "" and got[7] is None


def test_pii_needs_no_other_signs_in_the_text(spark):
    names = ["el señor García", "herr Müller", "monsieur Dupont", "DR. Smith", "г-н Иванов", "Г-н Иванов", "FRAU Weber-Schmidt", "jennifer and Jennifer Miller", "Александр Петров"]
    alone = ["a b.c@mail.example.com d", "password=abcdefgh1", "token: abcdefghij", "x 123-45-6789", "DE89370400440532013000", "97.51.17.173", "4111111111111111", "+491701234567", *names]
    got = pii.replace(docs(spark, list(enumerate(alone))), "k1", count="k").collect()
    assert all(r.k == 1 and r.text != alone[r.doc_id] for r in got)


def test_pii_keeps_form_gender_script_and_coreference(spark):
    got = dict(replaced(spark, PRIVATE))
    hosts = [re.search(r"\d+\.\d+\.\d+\.\d+", got[k]).group() for k in (1, None)]
    assert hosts[0] == hosts[1] and all(0 <= int(o) <= 255 for o in hosts[0].split("."))
    mails = re.findall(r"[\w.]+@[\w.]+", got[1])
    assert mails[0].lower() == mails[1].lower() and mails[0][0].isupper() and mails[1][0].islower()
    a, b = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[2])
    assert a.replace(" ", "") == b
    odd = [int(c) for c in b[-1::-2]]
    assert (sum(odd) + sum(sum(divmod(2 * int(c), 10)) for c in b[-2::-2])) % 10 == 0
    assert re.search(r'token = "[0-9a-f]{40}"', got[2])
    assert re.search(r"SSN \d{3}-\d{2}-\d{4}", got[3])
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met (\w+) (\w+) and Dr (\w+); (\w+) (\w+) left\.", got[4])
    assert m and m[1] in pii.FIRST["latin"]["f"] and (m[6], m[7]) == (m[1], m[2]) and m[3] in pii.FIRST["cyrillic"]["m"]
    assert re.fullmatch("[а-яА-Я]+", m[4])
    text = "Mrs. Jennifer Miller, Jennifer Miller, MRS Miller; Herr Xaver Huber, Herr Huber; Elizabeth Miller; token=abcd1234 secret: 'abcd1234'; A.B@c.de a.b@C.DE"
    (_, t), = replaced(spark, [(1, text)])
    m = re.fullmatch(r"Mrs\. (\w+) (\w+), (\w+) (\w+), MRS (\w+); Herr ([\w-]+) (\w+), Herr (\w+); (\w+) (\w+); token=(\w+) secret: '(\w+)'; (\S+) (\S+)", t)
    assert (m[1], m[2]) == (m[3], m[4]) and m[5] == m[2] == m[10] and m[9] != m[1] and m[7] == m[8] != m[2]
    assert m[6].split("-")[0] in pii.FIRST["latin"]["m"] and m[11] == m[12] != "abcd1234" and m[13].lower() == m[14].lower() != "a.b@c.de"


def test_pii_depends_on_key_and_is_stable(spark):
    assert replaced(spark, PRIVATE) == replaced(spark, PRIVATE) != replaced(spark, PRIVATE, key="other")
    assert replaced(spark, []) == []
    assert Counter(replaced(spark, PRIVATE * 2)) == Counter(replaced(spark, PRIVATE) * 2)


def test_pii_collisions_are_drawn_again_in_all_forms(spark, monkeypatch):
    real = pii._seed
    crowded = lambda kind, value, key, attempt: F.when(attempt < 2, F.sha2(kind.cast("binary"), 256)).otherwise(real(kind, value, key, attempt))
    monkeypatch.setattr(pii, "_seed", crowded)  # the first two draws are the same for all units of a kind
    card = lambda i: f"41111111111{10000 + i:05d}"
    apart = lambda c: " ".join(c[k : k + 4] for k in range(0, 16, 4))
    rows = [(i, f"at 20.0.0.{i} and 20.0.1.{i} end, {card(i)} or {apart(card(i))}, Mr. Surname{'abcdefghijklmnopqrst'[i]} and Jennifer Surname{'abcdefghijklmnopqrst'[i]}") for i in range(20)]
    got = dict(replaced(spark, rows))
    hosts = [x for t in got.values() for x in re.findall(r"\d+\.\d+\.\d+\.\d+", t)]
    assert len(hosts) == len(set(hosts)) == 40 and not {f"20.0.{k}.{i}" for k in (0, 1) for i in range(20)} & set(hosts)
    cards = [re.search(r"(\d{16}) or (\d{4} \d{4} \d{4} \d{4})", t).groups() for t in got.values()]
    assert all(a == b.replace(" ", "") for a, b in cards) and len({a for a, _ in cards}) == 20
    names = [re.search(r"Mr\. (\w+) and \w+ (\w+)$", t).groups() for t in got.values()]
    assert all(a == b for a, b in names) and len({a for a, _ in names}) == 20


def test_pii_has_room_for_more_names_than_short_ones(spark):
    """More surnames than three syllables can tell apart (4,096)."""
    word = lambda i: "Q" + "".join("aeioubcdfg"[int(d)] for d in f"{i:05d}")
    rows = [(b, "; ".join(f"Mr. {word(1000 * b + i)}" for i in range(1000))) for b in range(5)]
    drawn = [n for _, t in replaced(spark, rows) for n in re.findall(r"Mr\. (\w+)", t)]
    assert len(drawn) == len(set(drawn)) == 5000 and not {word(i) for i in range(5000)} & set(drawn)
    with pytest.raises(ValueError):
        pii.replace(docs(spark, rows), "")


def test_pii_is_a_consistent_injective_exchange(spark):
    """Against a plain dictionary: what is between entities stays, equal units map alike, different ones apart."""
    rng = random.Random(9)
    hosts = [f"{rng.randint(1, 223)}.{rng.randint(0, 255)}.1.{k}" for k in range(12)]
    mails = [f"user{k}@host{k % 3}.example.net" for k in range(12)]
    secrets = [f"{rng.randrange(16**12):012x}" for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice([rng.choice(hosts), rng.choice(mails), rng.choice(mails).upper(), "token=" + rng.choice(secrets), "password: " + rng.choice(secrets)]) for _ in range(rng.randint(0, 6))]
        rows.append((i, " | ".join(["start", *parts, "end"])))
    seen = {}
    for i, t in replaced(spark, rows):
        old, new = rows[i][1].split(" | "), t.split(" | ")
        assert len(old) == len(new) and (new[0], new[-1]) == ("start", "end")
        for a, b in zip(old[1:-1], new[1:-1], strict=True):
            head = re.match(r"(token=|password: )?", a).group()
            assert b.startswith(head) and a != b
            assert seen.setdefault(a[len(head) :].lower(), b[len(head) :].lower()) == b[len(head) :].lower()
    assert len(set(seen.values())) == len(seen) and not set(seen) & set(seen.values())


def test_pii_long_values_are_whole(spark):
    long = "A1b" * 20_000
    ((_, t),) = replaced(spark, [(1, f"token={long} x")])
    assert len(t) == len(long) + 8 and long not in t and t.endswith(" x")


# ---- quality rules --------------------------------------------------------


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "b", "ab", "#x", "é", "🎉", "a|b"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts += [None, "", " \n ", "x", "x y", "a b c a b c", "w " * 30000]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_quality_verdicts(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(quality_rules.COMMON["en"]) if rng.random() < 0.3 else "".join(rng.choice("abcdeinorst") for _ in range(6))
    good = [" ".join(word() for _ in range(200)) + "." for _ in range(30)]
    loud = " ".join(word() + "$$$***###" for _ in range(200))
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, [*enumerate(good), (90, loud), (91, loud), (92, None)])).collect()}
    assert all(got[i].kept for i in range(30)) and not got[90].kept and not got[91].kept and not got[90].base_failed
    assert got[92].base_failed and not got[92].kept
    assert quality_rules.judge(docs(spark, [])).count() == 0
    # A few documents are never their own measure: junk goes and prose stays, alone and in languages of their own.
    odd = {1: ("de", good[0]), 2: ("xx", " ".join(["q1@@##$$"] * 3 + [f"q{i}@@##$$" for i in range(90)])), 3: (None, good[1]), 4: ("ru", " ".join(["слово", "дом", "река", "утро"][i % 4] + "абвгд"[i % 5] * (i % 7) for i in range(90)) + "."), 5: ("de", loud)}
    alone = docs(spark, [(i, t) for i, (_, t) in odd.items()]).withColumn("lang", F.create_map(*(F.lit(x) for i, (code, _) in odd.items() for x in (i, code)))[F.col("doc_id")])
    assert {r.doc_id: r.kept for r in quality_rules.judge(alone, max_repeat_percent=100).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    short = " ".join(word() + "$$$***###" for _ in range(60))  # below the word guard, above the one of characters
    assert not quality_rules.judge(docs(spark, [*enumerate(good), (90, short)])).filter("doc_id = 90").first().kept
    odd = docs(spark, [*enumerate(good)]).withColumn("lang", F.lit(None).cast("string"))
    assert quality_rules.judge(odd).filter("kept").count() == 30


# ---- decontamination ------------------------------------------------------


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("toks", F.lit(1)).withColumn("n", F.lit("y"))


def prose(rng, n):
    return [f"{rng.choice('bcdfglmnpt')}{rng.choice('aeiou')}{rng.choice('bcdfglmnpt')}{rng.randint(0, 99)}" for _ in range(n)]


def test_leaks_are_found_with_substitutions(spark):
    rng = random.Random(5)
    bench = {i: prose(rng, 30) for i in range(8)} | {8: prose(rng, 9)}
    rows, want = [], set()
    for i, words in bench.items():
        changed = list(words)
        if len(words) > 20:
            for k in rng.sample(range(30), 3):
                changed[k] = "zzz"
        rows.append((i, " ".join(prose(rng, 50)) + " " + " ".join(changed).upper().replace(" ", ", ") + " " + " ".join(prose(rng, 50))))
        rows.append((100 + i, " ".join(prose(rng, 120))))
        rows.append((200 + i, " ".join(words[: len(words) // 3] + prose(rng, 90))))
        want.add((i, i))
    rows += [(300, None), (301, ""), (302, "one two"), (0, rows[0][1])]
    got = decontaminate.find(docs(spark, rows), items(spark, [(i, " ".join(w)) for i, w in bench.items()] + [(50, None), (51, "")]))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    shuffled = decontaminate.find(docs(spark, rows), items(spark, [(i, " ".join(w)) for i, w in bench.items()]), broadcast_rows=0)
    assert {(r.doc_id, r.item_id) for r in shuffled.collect()} == want


def test_leaks_at_the_limit_in_pieces_and_short(spark):
    rng = random.Random(15)
    word = lambda: f"w{rng.randrange(10**9)}"
    bench, rows, want = {}, [], set()

    def case(words, found):
        k = len(bench)
        bench[k] = words
        rows.append((k, " ".join([word() for _ in range(30)] + found + [word() for _ in range(30)])))
        want.add((k, k))

    for n in (16, 24, 40, 59):
        for _ in range(5):
            words = [word() for _ in range(n)]
            gone = set(rng.sample(range(n), n - -(-3 * n // 5)))
            case(words, [word() if i in gone else w for i, w in enumerate(words)])
        words = [word() for _ in range(n)]
        case(words, [word() if i % 4 == 3 else w for i, w in enumerate(words)])
        case(words := [word() for _ in range(n)], words[: n // 2] + [word()] + words[n // 2 :])
        case(words := [word() for _ in range(n)], words[: n // 2] + words[n // 2 + 1 :])
    case(words := [word() for _ in range(59)], words[:29])
    for n in range(1, 12):
        for gap in range(n if n > 2 else 0):
            case(words := [word() for _ in range(n)], [word() if i == gap else w for i, w in enumerate(words)])
        case(words := [word() for _ in range(n)], words)
    case(words := [word() for _ in range(5)], [w if i % 2 == 0 else word() for i, w in enumerate(words)])
    got = decontaminate.find(docs(spark, rows), items(spark, [(i, " ".join(w)) for i, w in bench.items()]))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_leaks_at_the_edges_and_empty_tables(spark):
    words = prose(random.Random(6), 20)
    bench = items(spark, [(1, " ".join(words)), (2, " ".join(words))])
    rows = [(1, " ".join(words)), (2, " ".join(words[:16])), (3, " ".join(words[6:] + ["x"] * 10)), (None, " ".join(words))]
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.find(docs(spark, rows), bench).collect()}
    assert got[1, 1] == got[1, 2] == got[None, 1] == 20 and got[2, 1] == 16 and got[3, 1] == 14
    assert decontaminate.find(docs(spark, []), bench).count() == 0 and decontaminate.find(docs(spark, rows), items(spark, [])).count() == 0
    kept = decontaminate.drop_contaminated(docs(spark, [*rows, (9, "clean text"), (None, "clean too"), (1, "also clean"), (1, None)]), bench)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(9, "clean text"), (None, "clean too"), (1, "also clean"), (1, None)])
    assert kept.columns == docs(spark, []).columns


def test_masks_hold_every_pattern_at_the_limit():
    """All patterns of agreement of up to 15 tokens: enough seeds wherever 60 % agree or a dense window or a run is there."""
    for n in range(1, 16):
        masks = decontaminate.SHORT.get(n, decontaminate.MASKS)
        least = -(-3 * n // 5)
        asked = 1 if n in decontaminate.SHORT else max(1, min(2, least - 2 * (n // 4) - min(n % 4, 2)))
        for bits in range(1 << n):
            width = min(n, decontaminate.WINDOW)
            dense = any((bits >> k & ((1 << width) - 1)).bit_count() * decontaminate.WINDOW >= width * decontaminate.DENSE for k in range(n - width + 1))
            if bits.bit_count() >= least or dense:
                seeds = sum(bits >> k & (m := int(mask, 2)) == m for mask in masks for k in range(n - len(mask) + 1))
                assert seeds >= asked, (n, bin(bits))


def plain_overlaps(doc, item, overlap=0.6):
    n, best, joined, run = len(item), 0, set(), 0
    for start in range(-n + 1, len(doc)):
        agree = [0 <= start + i < len(doc) and doc[start + i] == t for i, t in enumerate(item)]
        width = min(n, decontaminate.WINDOW)
        for k in range(n - width + 1):
            if 8 * sum(agree[k : k + width]) >= 6 * width:
                joined |= {i for i in range(k, k + width) if agree[i]}
        best = max(best, sum(agree))
        run = max(run, *(len(x) for x in "".join(".x"[a] for a in agree).split(".")))
    return best >= overlap * n - 1e-9 or len(joined) >= overlap * n - 1e-9 or run >= decontaminate.RUN


def test_leaks_match_brute_force(spark):
    rng = random.Random(16)
    bench = {i: [rng.choice("abcdefghijkl") for _ in range(n)] for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 16, 20, 24, 31, 40])}
    texts = {}
    for k in range(60):
        words = [rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(0, 60))]
        item = bench[rng.randrange(len(bench))]
        words[10:10] = [w if rng.random() < 0.75 else rng.choice(["x", "y z"]) for w in item]
        texts[k] = " ".join(words)
    want = {(d, i) for d, t in texts.items() for i, item in bench.items() if plain_overlaps(t.split(), item)}
    got = decontaminate.find(docs(spark, list(texts.items())), items(spark, [(i, " ".join(w)) for i, w in bench.items()]))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 60
