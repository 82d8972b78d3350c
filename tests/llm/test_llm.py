"""The llm operators against brute force, round trips and hand-made cases."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from vellum.llm import encoding, forms, leak, mix, overlap, spans, split
from vellum.llm.arrays import TextScan
from vellum.llm.text import words

VI = "Trạm kiểm tra lưu động có trách nhiệm mua bán sơ đồ tuyến quá hạn dọc theo kho hàng, mức 580.028.000 đồng. "


def _letters(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


# p2


def _pieces(spark, rows, limits):
    items = spark.createDataFrame([(k, i, t, 1) for k, i, t in rows], "kind string, key string, text string, pieces int")
    rules = spark.createDataFrame(limits, "item_kind string, max_chars int, overlap_chars int")
    out = {}
    for r in split.split_texts(items, rules, "kind", "key", "text").collect():
        out.setdefault((r["item_kind"], r["item_key"]), []).append(r)
    return {k: sorted(v, key=lambda r: r["piece_no"]) for k, v in out.items()}


def test_split_round_trip(spark):
    rng = random.Random(1)
    texts = {f"t{i}": rng.choice([_letters(rng, 50), VI * 30, "x" * 5000, "a\r\n" * 900, "ế" * 777, "Điều 1. a\n" * 200, _letters(rng, rng.randrange(1, 4000))]) for i in range(25)}
    texts["edge"] = "y" * 300
    rows = [("unit", k, t) for k, t in texts.items()] + [("unit", None, "z" * 999), ("unit", "null", None), ("unit", "empty", ""), ("other", "o", "z" * 999), ("unit", "t1", texts["t1"])]
    got = _pieces(spark, rows, [("unit", 300, 30)])
    assert {k for _, k in got} == {k for k, t in texts.items() if len(t) > 300}
    for (_, key), pieces in got.items():
        text = texts[key]
        assert pieces[0]["begin"] == 0 and pieces[-1]["end"] == len(text) and pieces[-1]["cut"] == "end"
        assert [p["piece_no"] for p in pieces] == list(range(1, len(pieces) + 1)) and {p["pieces"] for p in pieces} == {len(pieces)}
        assert all(len(p["text"]) <= 300 and p["text"] == text[p["begin"] : p["end"]] for p in pieces)
        assert all(b["begin"] == max(0, a["end"] - 30) for a, b in zip(pieces, pieces[1:], strict=False))
        assert pieces[0]["text"] + "".join(p["text"][a["end"] - p["begin"] :] for a, p in zip(pieces, pieces[1:], strict=False)) == text


def test_split_prefers_strong_boundaries():
    zone = "abc, def. ghi\nĐiều 2. jkl mno"
    assert split.best_cut("", zone, "x")[1] == "unit"
    assert split.best_cut("", "abc, def. ghi", "x") == (10, "sentence")
    assert split.best_cut("", "abcdef", "x") == (6, "none")
    assert split.best_cut("", "abcde\r", "\nx") == (5, "none")
    assert split.best_cut("", "abcde", "́x") == (4, "none")


def test_words_are_cut_only_where_they_are_too_long(spark, monkeypatch):
    rng = random.Random(12)
    rows = [("unit", "one", "a " * 29 + "x" * 40 + " b" * 60)]
    for i in range(150):
        rows.append(("unit", f"t{i}", " ".join("x" * rng.choice([1, 3, 9, 20, 50, 69, 70, 90, 120, 200]) for _ in range(rng.randrange(2, 60)))))
    for zones in (16, 1, 2):
        monkeypatch.setattr(split, "ZONES_PER_RANGE", zones)
        got = _pieces(spark, rows, [("unit", 80, 10)])
        assert not any(p["cut"] == "none" for p in got["unit", "one"])
        for (_, key), pieces in got.items():
            text = dict((k, t) for _, k, t in rows)[key]
            assert all(0 < len(p["text"]) <= 80 and p["text"] == text[p["begin"] : p["end"]] for p in pieces) and pieces[-1]["end"] == len(text)
            assert all(a["end"] < b["end"] and b["begin"] == max(0, a["end"] - 10) for a, b in zip(pieces, pieces[1:], strict=False))
            assert all(p["cut"] != "word" or text[p["end"] - 1] == " " for p in pieces)
            blanks = [0, *(i + 1 for i, c in enumerate(text) if c == " "), len(text)]
            assert sum(p["cut"] == "none" for p in pieces) == sum(max(0, -(-(b - a) // 70) - 1) for a, b in zip(blanks, blanks[1:], strict=False))


def test_split_files(spark, tmp_path):
    text = (VI + "\n") * 400 + "ế" * 3000 + "\n" + "x " * 900
    (tmp_path / "law.txt").write_text(text, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe x\n" * 300)
    for size in (5000, 10**9):
        found: dict = {}
        for r in split.split_files(spark, f"file://{tmp_path}", 1000, 100, range_bytes=size).collect():
            found.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
        assert set(found) == {"law.txt", "bad.txt"}
        for name, pieces in found.items():
            pieces.sort(key=lambda r: r["end"])
            raw = (tmp_path / name).read_bytes()
            assert all(len(p["text"]) <= 1000 and p["text"] == raw[p["begin"] : p["end"]].decode("utf-8", "replace") for p in pieces)
            assert pieces[0]["begin"] == 0 and pieces[-1]["end"] == len(raw) and pieces[-1]["cut"] == "end"
            assert all(len(raw[b["begin"] : a["end"]].decode("utf-8", "replace")) == min(100, len(a["text"])) for a, b in zip(pieces, pieces[1:], strict=False))
            assert all(p["cut"] != "none" or "ế" * 400 in p["text"] for p in pieces)


# p3


@pytest.mark.parametrize("hot", [5000, 3])
def test_overlap_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT", hot)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(120):
        base = rows[rng.randrange(len(rows))][1].split() if rows and rng.random() < 0.85 else [rng.choice(vocabulary) for _ in range(rng.randrange(1, 26))]
        new = [w for w in base if rng.random() > 0.04] + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 2))]
        rng.shuffle(new)
        rows.append((f"q{i:03}", " ".join(new), rng.choice(["train", " Train ", "dev", "TEST", "other", None]), rng.choice([["u1"], ["u1", "u2"], ["u2", "u3", None], [], None]), "x"))
    rows += [("n1", None, "train", ["u1"], "x"), (None, "w1 w2", "dev", ["u1"], "x"), ("e1", "", "dev", ["u1"], "x"), ("e2", "", "train", ["u1"], "x"), rows[0], rows[5]]
    df = spark.createDataFrame(rows, "id string, text string, split string, units array<string>, version string")
    got = {(r["train_id"], r["eval_id"]) for r in overlap.overlaps(df, "id", "text", "split", "units").collect()}
    want = set()
    for a, ta, sa, ua, _ in rows:
        for b, tb, sb, ub, _ in rows:
            if None in (a, b, ta, tb, sa, sb, ua, ub) or sa.strip().lower() != "train" or sb.strip().lower() not in ("dev", "test"):
                continue
            wa, wb = words(ta), words(tb)
            both = sum(min(wa.count(w), wb.count(w)) for w in set(wa))
            if wa and wb and (set(ua) & set(ub)) - {None} and 5 * both >= 4 * max(len(wa), len(wb)):
                want.add((a, b))
    assert got == want and len(want) > 20
    report = overlap.overlap_report(overlap.overlaps(df, "id", "text", "split", "units"), df, "id", "split", "version").collect()
    assert sum(r["pairs"] for r in report) == len({(t, e) for t, e in want})


def test_banded_program_and_segments():
    import numpy as np

    left, right = [[1, 2, 3, 4], [1, 1, 2], [5]], [[1, 3, 4, 9], [1, 2, 2], [6]]
    assert overlap.shared_words(left, right, np.array([4, 4, 2])).tolist() == [3, 2, 0]
    rng = random.Random(9)
    for _ in range(60):
        x, y = (sorted(rng.choices(range(40), k=rng.randrange(0, 300))) for _ in range(2))
        both = sum(min(x.count(w), y.count(w)) for w in set(x))
        assert overlap.shared_words([x], [y], np.array([len(x) + len(y)])).tolist() == [both]
        assert overlap.shared_words([x], [y], np.array([3]))[0] <= both
    for n in (*range(1, 90), 200, 333):
        for m in range(max(1, -(-4 * n // 5)), 5 * n // 4 + 1, 1 if n < 90 else 7):
            for rare in (0, 1, m // 3, m):
                parts = overlap.segment_starts(m, rare, overlap.most_edits(m))
                assert all(min(length, overlap.SEGMENT) in overlap.segment_lengths(n) for at, length in parts if at >= rare)
    for m in range(1, 60):
        k = overlap.most_edits(m)
        for rare in (0, m // 3, m):
            parts = overlap.segment_starts(m, rare, k)
            assert len(parts) == min(k + 1, m) and sum(n for _, n in parts) == m and all(n > 0 for _, n in parts)


def test_overlap_of_empty_table(spark):
    df = spark.createDataFrame([], "id string, text string, split string, units array<string>")
    assert overlap.overlaps(df, "id", "text", "split", "units").count() == 0


# p4


def _brute_pairs(texts, run):
    seen = {}
    for key, text in texts:
        for i in range(len(text or "") - run + 1):
            seen.setdefault(text[i : i + run], set()).add(key)
    return {(a, b) for keys in seen.values() for a in keys for b in keys if a is not None and b is not None and a < b}


def test_shared_runs_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    shared = [_letters(rng, n) for n in (29, 30, 31, 45, 200)]
    rows = [(f"u{i:02}", _letters(rng, rng.randrange(0, 60)) + rng.choice(shared) * rng.randrange(0, 3) + _letters(rng, rng.randrange(0, 60))) for i in range(60)]
    rows += [("u01", rows[1][1]), ("nil", None), (None, shared[4]), ("rep", "ab" * 40), ("rep2", "ab" * 30), ("same", "c" * 35), ("same2", "c" * 31)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "unit string, text string, length int, uid int")
    want = _brute_pairs([r for r in rows if r[0]], 30)
    held = {}
    for key, text in {(k, t) for k, t in rows if k and t}:
        for i in range(len(text) - 29):
            held.setdefault(text[i : i + 30], set()).add(key)
    covered = {}
    for key, text in {(k, t) for k, t in rows if k and t}:
        covered[key] = len({j for i in range(len(text) - 29) if len(held[text[i : i + 30]]) > 1 for j in range(i, i + 30)})
    for step in (400_000, 47):
        monkeypatch.setattr(spans, "STEP", step)
        assert {tuple(r) for r in spans.shared_pairs(df, "unit", "text", 30).collect()} == want
        share = {r["id"]: (r["chars"], r["shared_chars"]) for r in spans.shared_share(df, "unit", "text", 30).collect()}
        assert share == {k: (len(t or ""), covered.get(k, 0)) for k, t in rows if k}


def test_shared_runs_of_empty_table(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert spans.shared_pairs(empty, "a", "b").count() == 0 and spans.shared_share(empty, "a", "b").count() == 0


# p6


def test_odd_forms(spark):
    rows = [(1, "ＡＢ", "full_width"), (2, "quy dẻ", "apart_accent"), (3, "k​ép", "no_width"), (4, "a b", "odd_space"), (5, "hаi", "look_alike"), (6, "ðăng", "look_alike"), (7, "Москва α Δ m² “x”\t\r\n abîmé", ""), (8, "", ""), (9, None, ""), (None, "ＡＢ", "")]
    df = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "id int, text string, kinds string")
    got = {r["record_key"]: ",".join(r["kinds"]) for r in forms.odd_texts(df, "id", "text").collect()}
    assert got == {str(k): kinds for k, _, kinds in rows if kinds and k}
    assert {r["id"]: r["form"] for r in forms.canonical_texts(df, "text", "form").where("id is not null").collect()} == {1: "AB", 2: "quy dẻ", 3: "kép", 4: "a b", 5: "hai", 6: "đăng", 7: "Москва α Δ m² “x”\t\r\n abîmé", 8: "", 9: None}


# p7


def test_leaks_match_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = [f"từ{i}" for i in range(400)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, line(rng.randrange(0, 90))) for i in range(40)]
    docs = []
    for i in range(120):
        own = rng.choice(items)[1]
        n, at = rng.choice([24, 25, 26, 60]), rng.randrange(0, max(1, len(own)))
        docs.append((i, line(rng.randrange(0, 80)) + own[at : at + n] + line(rng.randrange(0, 80))))
    text = lambda ws: ", ".join(w.upper() if rng.random() < 0.3 else w for w in ws)
    ddf = spark.createDataFrame([(i, text(w), 0) for i, w in docs] + [(900, None, 0), (901, "", 0), (None, text(items[0][1]), 0), (3, text(docs[3][1]), 0)], "doc bigint, body string, item int")
    idf = spark.createDataFrame([(i, text(w)) for i, w in items] + [(800, None), (None, "x"), (5, text(items[5][1]))], "item bigint, passage string")
    want = set()
    for i, w in docs:
        grams = {tuple(w[k : k + 25]) for k in range(len(w) - 24)}
        want |= {(i, j) for j, v in items if any(tuple(v[k : k + 25]) in grams for k in range(len(v) - 24))}
    for known in (10**6, 5):
        monkeypatch.setattr(leak, "KNOWN", known)
        assert {tuple(r) for r in leak.contained_items(ddf, "doc", "body", idf, "item", "passage").collect()} == want
    assert len(want) > 20
    assert leak.contained_items(ddf, "doc", "body", idf.where("false"), "item", "passage").count() == 0


# p8


def test_fit_meets_budgets():
    rng = random.Random(8)
    for _ in range(200):
        counts = {rng.randrange(1, 60): rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))}
        total, copies = sum(n * c for n, c in counts.items()), rng.randrange(1, 4)
        budget = rng.randrange(0, total * copies + 5)
        got = mix.fit(counts, budget, copies)
        used = sum(n * c for n, c in got.items())
        assert used <= budget and all(c <= counts[n] * copies for n, c in got.items())
        assert budget > total * copies or budget - used < 60
    assert mix.fit({3: 2, 5: 1}, 8, 1) == {3: 1, 5: 1} and mix.fit({}, 5, 1) == {} and mix.fit({4: 1}, 0, 2) == {}


def test_mix_shares(spark):
    rows = [(i, VI * (1 + i % 5), "a" if i % 3 else "b") for i in range(300)] + [(400, None, "a"), (401, "", "b"), (402, VI, None), (403, VI, "c"), (None, VI, "a")]
    docs = spark.createDataFrame([(k, t, s, 7) for k, t, s in rows], "doc_id bigint, text string, source string, n_tokens int").repartition(3)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("z", 0.1, 3)], "source string, target_share double, max_repeats int")
    chosen = mix.mix(docs, "doc_id", "text", "source", targets, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    got = chosen.collect()
    assert {r["source"] for r in got} == {"a", "b"} and all(1 <= r["copies"] <= {"a": 1, "b": 2}[r["source"]] for r in got)
    tokens = {s: sum(r["n_tokens"] * r["copies"] for r in got if r["source"] == s) for s in "ab"}
    assert abs(tokens["a"] / sum(tokens.values()) - 5 / 9) < 0.01
    shares = {r["source"]: r for r in mix.shares(chosen, targets).collect()}
    assert shares["z"]["documents"] == 0 and shares["a"]["tokens"] == tokens["a"]
    again = mix.mix(docs, "doc_id", "text", "source", targets, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix.mix(docs.where("false"), "doc_id", "text", "source", targets, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken").count() == 0


# p9


def _garble(text, written, read):
    return text.encode(written).decode(read, "replace")


def test_wrong_encodings_are_undone(spark):
    clean = [(i, f"{VI} Người điều khiển xe số {i} phải dừng đỗ đúng nơi quy định. Phụ xe được nghỉ ở bến.", "vi") for i in range(60)]
    bad = "Người điều khiển xe phải dừng đỗ đúng nơi quy định trên đường"
    cp = "".join(c if ord(c) < 256 else c for c in bad)
    tcvn = {c: chr(0xA1 + i) for i, c in enumerate(encoding.TCVN3) if c != "."}
    rows = clean + [
        (100, _garble(bad, "utf-8", "mac_roman"), "vi"), (101, _garble(bad, "utf-8", "cp437"), "vi"),
        (102, bad.encode("utf-8").decode("latin-1"), "vi"), (103, "".join(tcvn.get(c, c) for c in cp), "vi"),
        (104, bad + " " + "tại".encode().decode("latin-1") + " bến", "vi"),
        (200, "LốpBền® ©2021 €4, £2; µm §7 Øster", "vi"), (201, "ðường ðêm Ðại lý", "vi"), (202, None, "vi"), (203, "", None), (None, _garble(bad, "utf-8", "cp437"), "vi"),
    ]
    df = spark.createDataFrame([(k, t, lang, "x") for k, t, lang in rows], "id int, text string, lang string, restored string")
    got = {r["doc_id"]: r["restored"] for r in encoding.restore_encoding(df, "id", "text", "lang").collect()}
    assert set(got) == {100, 101, 102, 103, 104}
    assert got[100] == got[101] == got[102] == got[103] == bad and got[104] == bad + " tại bến"


def test_every_letter_is_suspicious_after_every_chain():
    scan = TextScan(encoding.SUSPECT, encoding.SUSPECT_PAIRS)
    seen = 0
    for chain in encoding.CHAINS:
        for letter in encoding.CORRECT:
            read = encoding.misread(chain, letter)
            if read is None or read in encoding.CORRECT or read in encoding._CORRECT_PAIRS:
                continue  # the encoding lacks it, or the reading is itself correct text
            assert scan([read]) == [0] and encoding._SUSPECT.search(read), (chain, letter, read)
            seen += 1
        assert not chain.startswith("utf8") or all(encoding.misread(chain, x) not in encoding.CORRECT for x in encoding.CORRECT)
    assert encoding.misread("utf8>cp1252", "ố") == "á»‘" and encoding.misread("cp1258>cp1252", "ế") == "êì" and encoding.misread("tcvn3>cp1252", "đ") == "®"
    assert seen > 700 and scan(["Giò chả, quì gối, «đã» là… “Việt” ‘Nam’ – 20°"]) == []


def test_one_damaged_word_is_enough(spark):
    clean = [(i, f"{VI} Nguyễn Văn Hồ từ số {i} đến cuối đường có tốc độ hỗ trợ.", "vi") for i in range(60)]
    words_ = ["số", "từ", "hồ", "Nguyễn", "hỗ", "cuối", "tốc"]
    bad = [(100 + i, f"{VI} {_garble(w, 'utf-8', 'cp1252')} xe.", "vi") for i, w in enumerate(words_)]
    got = {r["doc_id"]: r["restored"] for r in encoding.restore_encoding(spark.createDataFrame(clean + bad, "id int, text string, lang string"), "id", "text", "lang").collect()}
    assert got == {100 + i: f"{VI} {w} xe." for i, w in enumerate(words_)}


def test_lost_bytes_and_empty_input(spark):
    lang = encoding.Language([VI.encode(), "người điều thời gian".encode()])
    assert encoding.Restorer([lang]).restore("NgÆ°á»�i Ä‘iá»�u")[0] == "Người điều"
    # one word of many lost bytes, and damage that nothing can undo
    assert encoding.Restorer([lang]).restore("á»�iá»�uá»�iá»�uá»�i")[0].count(chr(0xFFFD)) == 0
    lost = spark.createDataFrame([(1, "xe t" + chr(0xFFFD) + "i", "vi"), (2, chr(0xFFFD) + " 5", "vi"), (3, VI, "vi")], "id int, text string, lang string")
    assert [(r["doc_id"], r["chains"], r["restored"] == "xe t" + chr(0xFFFD) + "i") for r in encoding.restore_encoding(lost, "id", "text", "lang").collect()] == [(1, [], True)]
    assert encoding.restore_encoding(spark.createDataFrame([], "id int, text string, lang string"), "id", "text", "lang").count() == 0


def test_all_documents_are_counted(spark):
    """Words, letters and dictionary come from every clean document, wherever in it, whatever the partitions."""
    rows = [(i, f"{'xe ' * 2000}đường {chr(0x4E00 + i)} từ{i}" , " VI" if i % 2 else "vi") for i in range(700)] + [(900, "đường táº¡i", "vi"), (901, "đường", None), (902, "đường fin", "fr")]
    df = spark.createDataFrame(rows, "id int, text string, lang string")
    vi, fr = encoding.train(df, "text", "lang")
    assert vi.words["đường"] == 700 and vi.words["xe"] == 700 * 2000 and vi.words["từ650"] == 1 and fr.words["đường"] == 1
    assert {chr(0x4E00 + i) for i in range(700)} <= vi.letters and "¡" not in vi.letters
    other = encoding.train(df.repartition(7), "text", "lang")[0]
    assert other.data == vi.data and other.letters == vi.letters and (other.words.cells == vi.words.cells).all()
    pairs = [("a", "b", 3), ("b", "a", 2), ("b", None, 1), ("c", "a", 1)]
    walked = [x.split() for x in encoding._walk(pairs)]
    assert sorted((x, y) for w in walked for x, y in zip(w, w[1:], strict=False)) == sorted((x, y) for x, y, n in pairs if y for _ in range(n))


def test_held_out_texts_are_restored(spark):
    """Clean documents that the sample didn't draw, misread along every chain, in whole or in one sentence."""
    rng = random.Random(13)
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lower(trim(lang)) = 'vi' and length(text) < 3000").select("doc_id", "text").orderBy("doc_id").collect() if not encoding._SUSPECT.search(r["text"]) and not r["text"].isascii()]
    rng.shuffle(rows)
    held, known = rows[:60], rows[60:360]
    restorer = encoding.Restorer([encoding.Language([x["text"][i : i + 200].encode() for x in known for i in range(0, len(x["text"]), 200)])])
    seen = exact = 0
    for n, row in enumerate(held):
        chain = list(encoding.CHAINS)[n % len(encoding.CHAINS)]
        parts = unicodedata.normalize("NFC", row["text"]).split(". ")
        which = range(len(parts)) if n % 3 == 0 else [rng.randrange(len(parts))]
        bad = [". ".join("".join(encoding.misread(chain, c) or c for c in x) if i in which else x for i, x in enumerate(parts))][0]
        if bad == ". ".join(parts):
            continue
        got = restorer.restore(bad)[0].split(". ")
        seen += len(which)
        exact += sum(i < len(got) and got[i] == parts[i] for i in which)
    assert seen > 100 and exact / seen > 0.9, (exact, seen)


# very long texts, and a key that holds a third of the rows


def test_very_long_texts(spark):
    rng = random.Random(11)
    long = [" ".join(rng.choice(["xe", "tải", "dừng", "đỗ", "đường"]) + str(rng.randrange(10**6)) for _ in range(40_000)) for _ in range(2)]
    passage = " ".join(long[0].split()[20_000:20_040])
    docs = spark.createDataFrame([(1, long[0], "vi"), (2, long[1] + " " + passage, "vi"), (3, "tại ".encode().decode("latin-1") * 9000, "vi")], "id bigint, text string, lang string")
    items = spark.createDataFrame([(7, passage)], "item bigint, passage string")
    assert {tuple(r) for r in leak.contained_items(docs, "id", "text", items, "item", "passage").collect()} == {(1, 7), (2, 7)}
    assert [tuple(r) for r in spans.shared_pairs(docs, "id", "text").collect()] == [(1, 2)]
    assert {r["id"] for r in spans.shared_share(docs, "id", "text").where(F.col("shared_chars") >= len(passage)).collect()} == {1, 2}
    assert {r["doc_id"] for r in encoding.restore_encoding(docs, "id", "text", "lang").collect()} == {3}
    assert {r["record_key"] for r in forms.odd_texts(docs.withColumn("text", F.concat("text", F.lit("​"))).where("id <> 2"), "id", "text").collect()} == {"1", "3"}
    pieces = _pieces(spark, [("unit", "a", long[0])], [("unit", 1200, 120)])["unit", "a"]
    assert "".join(p["text"][0 if p["piece_no"] == 1 else 120 :] for p in pieces) == long[0]
    words_a = long[0].split()[:1500]
    pairs = spark.createDataFrame([("a", " ".join(words_a), "train", ["u"]), ("b", " ".join(words_a[100:] + ["x"] * 90), "dev", ["u"])], "id string, text string, split string, units array<string>")
    assert overlap.overlaps(pairs, "id", "text", "split", "units").count() == 1


def test_hot_keys(spark):
    # one unit, one text, one source and one document hold a third of the rows
    rows = [(f"q{i:03}", f"câu hỏi số {i % 60} về xe tải dừng đỗ trên đường {i % 7}", "train" if i % 2 else "dev", ["hot"] if i % 3 == 0 else [f"u{i}"]) for i in range(240)]
    df = spark.createDataFrame(rows, "id string, text string, split string, units array<string>")
    got = {(r["train_id"], r["eval_id"]) for r in overlap.overlaps(df, "id", "text", "split", "units").collect()}
    hot = [(k, words(t), s) for k, t, s, u in rows if u == ["hot"]]
    assert got == {(a, b) for a, wa, sa in hot for b, wb, sb in hot if sa == "train" and sb == "dev" and 5 * sum(min(wa.count(w), wb.count(w)) for w in set(wa)) >= 4 * max(len(wa), len(wb))}
    copies = spark.createDataFrame([(f"c{i:03}", VI * 2 if i % 3 == 0 else VI[:100] + f"{i:03}" * 20) for i in range(240)], "unit string, text string")
    assert spans.shared_pairs(copies, "unit", "text").count() == 80 * 79 // 2
    # a passage in every one of many texts: no pairs are made for the share
    many = spark.range(20_000).select(F.col("id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(VI * 2), F.sha2((F.col("id") + 1).cast("string"), 256)).alias("text"))
    assert {r["shared_chars"] >= len(VI * 2) for r in spans.shared_share(many, "id", "text").select("shared_chars").distinct().collect()} == {True}
