import re

from shelfline.llm import secret_scan as s

PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 20),
    "hex": (re.compile("[0-9a-f]+"), 24),
}
KEY = "AKIA" + "Q2W3E4R5T6Y7U8I9"
LIVE = "Zx9Kq2Lm8Vb4Nc6Td1Rf"
HEX = "0123456789abcdef01234567"


def base(text):
    found = []
    for order, (kind, (pattern, least)) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            if len(m.group(2) if kind == "assign" else m.group()) >= least:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(found))


TEXTS = [
    None, "", "password=abc", "PASSWORD = 'hunter22' and token:\"abcdef\" é\U0001f600 secret=xyzxyz", "secret:token:abcdefgh", "token==abcdefg",
    f"{KEY} {KEY}x AKIAAKIA{KEY}", f"api_key={HEX}{HEX} {HEX} {HEX[:23]} {HEX}g{HEX}", f"é {LIVE} token={LIVE}", "apikey  =  \"AKIA.=-+/_\"",
    ("word " * 50_000) + f"passwd: {HEX}", f"token={HEX}" * 300, "ToKeN:a:b password=password=123456",
]


def docs(spark, texts, owners=("o1", "o2")):
    rows = [(i, t, owners[i % len(owners)], 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kind int")


def test_base_spans_equal_the_patterns(spark):
    frame = docs(spark, TEXTS)
    got = {r["doc_id"]: r for r in s.scan(frame.unionByName(frame)).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i]["base"] == base(text), text
        assert got[i]["n_hex"] == base(text).count("hex:")
    assert s.scan(frame.unionByName(frame)).count() == 2 * len(TEXTS)


def test_live_runs_are_added_unless_widely_copied(spark):
    texts = [f"see {LIVE} here", f"password={LIVE}", "thththththththththththth", f"{LIVE[::-1]}"]
    got = {r["doc_id"]: r["spans"] for r in s.scan(docs(spark, texts)).collect()}
    assert got == {0: "live:4:24", 1: "assign:0:29", 2: "", 3: "live:0:20"}
    copied = [f"{n} {LIVE} password={HEX}" for n in range(8)]
    found = s.scan(docs(spark, copied, owners=[f"o{n}" for n in range(8)])).collect()
    assert all(r["n_live"] == 0 and r["n_example"] == 2 and "live" not in r["spans"] for r in found)
    # Many repositories of one owner do not make an example.
    assert all(r["n_live"] == 3 for r in s.scan(docs(spark, copied, owners=["o"])).collect())


def test_ownership_counts(spark):
    frame = docs(spark, ["password=abcdef1", "token=abcdef1", "secret=abcdef1", None], owners=["a", None])
    row = s.ownership(s.candidates(frame)).first()
    assert (row["repositories"], row["owners"]) == (3, 2)


def test_masks_live_values_only(spark):
    rows = [(i, f"{i} password='example{1}' x", f"o{i}", 0) for i in range(6)]
    rows += [(10, f"é token={HEX}, {LIVE}. end", "o1", 0), (11, None, None, 0), (12, "clean", "o1", 0), (13, f"token={HEX}token={HEX}", "o1", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in s.mask(frame).collect()}
    assert got[10] == ("é token=[SECRET], [SECRET]. end", 31)
    assert got[11] == (None, 0) and got[12] == ("clean", 0)
    assert got[0][0] == "0 password='example1' x"
    assert HEX not in got[13][0]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert s.scan(frame).count() == 0
    assert s.mask(frame).count() == 0
