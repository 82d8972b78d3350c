"""The window parser against a line-by-line reading of the same rules."""

import random
import re

from vellum.operators import hierarchy, normalize

RANK = {t: i for i, t in enumerate(hierarchy.TYPES)}
RULES = {t: re.compile(h.split(")", 1)[1], re.IGNORECASE if "i" in h.split(")", 1)[0] else 0) for t, h in hierarchy.HEADINGS.items()}


def sequential(document, text, strict=False):
    """Units in order as (id, type, number, title, text, parent, path), one line after the other."""
    raw = [x.strip() for x in text.splitlines() if x.strip()]
    lines, i = [], 0
    while i < len(raw):
        if re.fullmatch("phần|chương|mục", raw[i], re.IGNORECASE) and i + 1 < len(raw):
            lines.append(raw[i] + " " + raw[i + 1])
            i += 2
        else:
            lines.append(raw[i])
            i += 1
    stack, units, inside, balance = [], [], False, 0
    for line in lines:
        if re.match(r"phụ lục(\s|$)", line, re.IGNORECASE):
            break
        quoted = line.startswith("“") or (balance > 0 if strict else inside)
        balance += line.count("“") - line.count("”")
        if quoted:
            if stack:
                stack[-1]["body"].append(line)
            inside = line.count("“") > line.count("”")
            continue
        kind, m = next(((t, m) for t in hierarchy.TYPES if (m := RULES[t].match(line)) and (RANK[t] < 4 or any(u["type"] == "article" for u in stack))), (None, None))
        if kind is None:
            if stack:
                top = stack[-1]
                if RANK[top["type"]] < 3 and top["title"] is None and line.isupper():
                    top["title"] = line
                else:
                    top["body"].append(line)
            continue
        while stack and RANK[stack[-1]["type"]] >= RANK[kind]:
            stack.pop()
        number = m[1].lower() if kind == "point" else m[1].strip()
        parent = stack[-1] if stack else None
        base = document if kind == "article" or parent is None else parent["id"]
        unit = {"id": f"{base}::{kind}::{number}", "type": kind, "number": number, "title": (m[2] or "").strip() or None, "body": [], "parent": parent and parent["id"], "path": (parent["path"] if parent else []) + [f"{base}::{kind}::{number}"]}
        stack.append(unit)
        units.append(unit)
    return [(u["id"], u["type"], u["number"], u["title"], "\n".join(x for x in [u["title"], *u["body"]] if x), u["parent"], u["path"]) for u in units]


def parsed(spark, texts, strict=False):
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in texts.items()], "doc string, body string, line string, owner int")
    out = {k: [] for k in texts}
    for r in sorted(hierarchy.parse_units(df, "doc", "body", strict).collect(), key=lambda r: (r["document_id"], r["ordinal"])):
        out[r["document_id"]].append((r["unit_id"], r["unit_type"], r["number"], r["title"], r["text"], r["parent_id"], r["path"]))
    return out


def test_random_line_sequences(spark):
    rng = random.Random(2)
    parts = [
        "PHẦN THỨ NHẤT", "Phần II. Tên phần", "PHẦN", "Chương I", "CHƯƠNG II ĐƯỜNG", "Chương", "III", "Mục 1. Tên", "MỤC", "2", "Điều 1. Quy định", "ĐIỀU 2.", "Điều 3a Tên", "1. Nội dung", "2a. Nội dung", "3.", "a) Điểm",
        "Đ) Điểm đ", "b)", "QUY ĐỊNH CHUNG", "Văn bản thường", "“Trích dẫn", "“Trích” xong", "tiếp theo”", "có “mở mà không đóng", "“1. Trong ngoặc", "2. Hết ngoặc”", "PHẦN ĐẤT ĐỂ BẢO VỆ", "  ", "\t1. lùi", "12345", "ABC 1”",
    ]
    texts = {f"d{i}": "\n".join(rng.choice(parts) for _ in range(rng.randrange(0, 22))) + rng.choice(["", "", "\r\nPHỤ LỤC I\r\nĐiều 9. Không tính"]) for i in range(500)}
    texts |= {"empty": "", "cr": "Điều 1. a\r1. b\r\n\r\na) c"}
    for strict in (False, True):
        got = parsed(spark, texts, strict)
        for k, t in texts.items():
            assert got[k] == sequential(k, t, strict), (k, strict, t)


def test_known_cases(spark):
    texts = {
        "split": "Chương\nVI Đường cao tốc\nMục 1\nPhạm vi\nĐiều 1. Quy định chung",
        "quote": "Điều 1. Sửa đổi\n1. Như sau:\n“1. Thay thế.\n2. Được sửa đổi.”\n2. Tiếp theo.",
        "noun": "Chương III\nPHẦN ĐẤT ĐỂ BẢO VỆ ĐƯỜNG BỘ\nĐiều 10. Chung",
    }
    got = parsed(spark, texts)
    assert [u[0] for u in got["split"]] == ["split::chapter::VI", "split::chapter::VI::section::1", "split::article::1"] and got["split"][0][3] == "Đường cao tốc"
    assert got["split"][2][5] == "split::chapter::VI::section::1"
    assert [u[0] for u in got["quote"]] == ["quote::article::1", "quote::article::1::clause::1", "quote::article::1::clause::2"] and "2. Được sửa đổi.”" in got["quote"][1][4]
    assert got["noun"][0][3] == "PHẦN ĐẤT ĐỂ BẢO VỆ ĐƯỜNG BỘ"


def test_violations(spark):
    df = spark.createDataFrame([("d", "d::article::1", "x", None), ("d", "d::article::1", "y", None), ("d", "e::article::1", "x", None), ("d", "d::article::2", "", "d::chapter::9")], "document_id string, unit_id string, text string, parent_id string")
    assert {tuple(r)[1:] for r in hierarchy.unit_violations(df).collect()} == {("d::article::1", "DUPLICATE"), ("e::article::1", "FOREIGN"), ("d::article::2", "EMPTY"), ("d::article::2", "ORPHAN")}


def test_html_and_corrections(spark):
    html = "<title>T</title><p>Điều 1.&nbsp;A   b</p><script>x()</script><br/>\r\n<div>1. c</div><style>p{}</style><!-- no -->  d\n\n\n\ne"
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    text = [r[0] for r in df.select(normalize.html_column(df["html"])).collect()]
    assert text == ["T\nĐiều 1. A b\n\n1. c\nd\n\ne", None, ""]
    rows = [("aa a", [("aa", "b", 1), ("b", "c", 2)]), ("x", None), (None, [("a", "b", 1)])]
    df = spark.createDataFrame(rows, "t string, c array<struct<find:string,replace:string,expected_count:int>>")
    out = [r["x"] for r in df.select(normalize.corrected(df["t"], df["c"]).alias("x")).collect()]
    assert out[0]["text"] == "c a" and out[0]["wrong"] == ["1 of 2: b"] and out[1]["text"] == "x" and out[1]["wrong"] == []
