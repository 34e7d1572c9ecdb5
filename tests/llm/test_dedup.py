import random
import re

import numpy as np
import pytest
import xxhash
from helpers import PASSAGE, awkward, documents, empty

from tracewise.llm import components, simhash, substring_dedup
from tracewise.sources.tables import table

SF = "/root/testdata/sf0.001"


def slow_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius=3):
    label = list(range(len(fps)))
    near = [[j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius] for i in range(len(fps))]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def check_components(rows):
    fps = [int(r.fingerprint, 16) for r in rows]
    label = slow_components(fps)
    first = {}
    for r, k in zip(rows, label):
        if r.doc_id is not None:
            first[k] = min(first.get(k, r.doc_id), r.doc_id)
    assert [r.component_id for r in rows] == [first.get(k) for k in label]


def test_fingerprints_and_components_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = simhash.near_duplicates(docs).collect()
    assert all(r.fingerprint == f"{slow_simhash(texts[r.doc_id]):016x}" for r in rows)
    check_components(rows)


@pytest.mark.parametrize("tile", [1, 4, 1024])
def test_crowded_shards_keep_every_link(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    fps = {0, (1 << 63) - 1}
    for _ in range(4):  # clusters that share whole blocks, with chains across their borders
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.close_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"))
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    label = slow_components(fps)
    groups = {}
    for x, k in zip(fps, label):
        groups.setdefault(k, set()).add(signed(x))
    for g in groups.values():
        assert {got.get(x, x) for x in g} == {min(g)}


def test_a_large_shard_is_cut_finer(spark):
    """All fingerprints share one block; tile pairs alone would copy each of them 256 times."""
    from pyspark.sql import functions as F
    fps = spark.range(1 << 18).select(F.shiftleft(F.xxhash64("id"), 16).alias("fp")).distinct()
    sizes = simhash.shards_of(fps).groupBy("block", "value").count().filter("count > 1")
    copies = sizes.agg(F.sum(F.col("count") * F.ceil(F.col("count") / simhash.TILE))).first()[0]
    assert copies < 25 * (1 << 18)


def test_every_close_pair_shares_a_finer_shard():
    rng = random.Random(9)
    for radius in (0, 1, 3, 5):
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not own & flips and any(not m & flips for m in finer) for own, finer in simhash.shard_masks(radius))
            assert all(any(not m & flips for m in finer) for own, finer in simhash.shard_masks(radius) if not own & flips)


def test_long_chain_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(chain).collect()}
    assert got == {i: 0 for i in range(101)} | {500: 500, 501: 500}


def test_one_of_each(spark):
    docs = awkward(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 2 and 2 in ids and 3 not in ids and 4 not in ids and None in ids  # 2, 3 and 4 have no words
    check_components(simhash.near_duplicates(docs).collect())
    assert simhash.one_of_each(empty(spark)).count() == 0


def slow_strip(rows):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    left = [None] * len(rows)
    for k in order:
        parts = substring_dedup.sentences(rows[k][1])
        words = [p.lower().split() for p in parts]
        idx = [i for i, w in enumerate(words) if w]
        gone = set()
        size = [len(words[i]) for i in idx]
        enough = lambda a, b: b - a >= 1 and sum(size[a:b + 1]) >= 20
        runs = set()
        for a in range(len(idx)):
            if size[a] >= 40:
                runs.add((a, a))
                continue
            runs.update([(a, b) for b in range(a, len(idx)) if enough(a, b)][:1])
            runs.update([(c, a) for c in range(a, -1, -1) if enough(c, a)][:1])
        for a, b in sorted(runs):
            key = " ".join(" ".join(words[idx[x]]) for x in range(a, b + 1))
            if key in seen:
                gone.update(range(idx[a], idx[b] + 1))
            seen.add(key)
        left[k] = "".join(p for i, p in enumerate(parts) if i not in gone)
    return left


def test_span_dedup_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(docs).collect()}
    want = dict(zip([i for i, _ in rows], slow_strip(rows)))
    assert got == want
    assert any(len(want[i]) < len(t) for i, t in rows)


def test_passage_stays_once(spark):
    own = [(i, f"Opening line number {i} of this page is its own.\n{PASSAGE} Closing words {i} differ as well.") for i in (3, 1, 2)]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(documents(spark, own)).collect()}
    assert PASSAGE in got[1].text and got[1].n_removed == 0
    for i in (2, 3):
        assert "harbour" not in got[i].text and "kitchens" not in got[i].text and got[i].text.startswith(f"Opening line number {i}")


def test_short_last_sentence_of_a_passage_goes(spark):
    passage = PASSAGE + " So it ended."
    own = [(i, f"Page {i} has an opening. {passage} Then page {i} has words {' '.join(f'w{i}x{k}' for k in range(30))}.") for i in (1, 2)]
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(documents(spark, own)).collect()}
    assert passage in got[1] and "So it ended" not in got[2] and got[2].startswith("Page 2 has an opening. Then page 2")


def test_span_dedup_awkward_rows(spark):
    docs = awkward(spark)
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {(r.doc_id, r.source): r.text for r in out.collect()}
    assert rows[(2, "a")] is None and rows[(3, None)] == "" and rows[(5, "a")]
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_sentences_join_to_the_text():
    for t in ("", "a", "a. b", "3.14 is. Not\n\n two!? x", "...", "\n", " lead. \n tail "):
        assert "".join(substring_dedup.sentences(t)) == t


def test_bk_search_finds_every_pair():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    shard = np.zeros(len(fps), dtype=int)
    a, b = simhash.bk_links(shard, fps, np.arange(len(fps)), 2)
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if i != j and int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want


CHINESE = ("老港长在暴风雨来临之前把每一条船都数了两遍。他把数字记在一本绿色的本子里。后来再也没有人要求看那本本子！水涨起来的时候书页一张一张漂走了。"
           "孩子们沿着海岸把它们捡起来，保存了很多年。有人问“为什么？”其中一些至今还挂在山上的厨房里。")
HINDI = ("बूढ़े बंदरगाह प्रमुख ने तूफान आने से पहले हर नाव को दो बार गिना। उसने संख्याओं को एक हरी किताब में लिख दिया। "
         "उसके बाद किसी ने भी वह किताब देखने को नहीं कहा। बच्चों ने पन्नों को किनारे पर पकड़ा और बरसों तक संभाल कर रखा।")
THAI = "นายท่าเรือเก่านับเรือทุกลำสองครั้งก่อนพายุจะมา เขาเขียนตัวเลขลงในสมุดสีเขียว ไม่มีใครขอดูสมุดเล่มนั้นอีกเลย เมื่อน้ำขึ้นหน้ากระดาษก็ลอยออกไปทีละแผ่น เด็กๆเก็บไว้ตามชายฝั่งหลายปี"


def test_sentences_of_other_scripts():
    cut = substring_dedup.sentences
    assert cut("他走了。她说“好！”天黑了") == ["他走了。", "她说“好！”", "天黑了"]
    assert cut("एक बात। दूसरी बात।") == ["एक बात। ", "दूसरी बात।"] and cut("ماذا؟ نعم") == ["ماذا؟ ", "نعم"]
    assert cut("นายท่า เขาเขียน") == ["นายท่า ", "เขาเขียน"]
    assert cut("Übergröße 3.5 m. Ende… ja") == ["Übergröße 3.5 m. ", "Ende… ja"]
    for text in (CHINESE, HINDI, THAI, PASSAGE):
        assert "".join(cut(text)) == text and len(cut(text)) > 3
    assert substring_dedup.word_count("他有3本book。", ["他有3本book。"]) == 4 and substring_dedup.word_count("öl - 3", ["öl", "-", "3"]) == 3


def test_passages_of_other_scripts_stay_once(spark):
    for passage, opening, closing in ((CHINESE, "第{}页有自己的开头。", "第{}页的结尾也不同。"), (HINDI, "पन्ना {} अलग है। ", " पन्ना {} का अंत भी अलग है।"),
                                      (THAI, "หน้าที่{}มีคำเปิด ", " หน้าที่{}จบต่างกัน")):
        own = [(i, opening.format(i) + passage + closing.format(i)) for i in (2, 1)]
        got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(documents(spark, own)).collect()}
        assert got[1] == own[1][1] and got[2] == opening.format(2) + closing.format(2).lstrip()
        one_line = [(i, passage.replace("。", "，").replace("।", ",").replace(" ", "") + f"\n{i}") for i in (1, 2)]
        if passage != HINDI:  # one long sentence without spaces
            got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(documents(spark, one_line)).collect()}
            assert got[1] == one_line[0][1] and got[2] == "2"
