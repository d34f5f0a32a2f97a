"""The dialect and the planner, with DuckDB's engine of the same dialect as judge."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions.regex import QueryError, can_be_empty, chain, guard, parse, program_size, quote, width
from quarry.operators.search import Pattern
from quarry.plans import planner

TEXTS = [
    "", "a", "foo\r", "foo", "b\x0bx", "aé", "a é", "kmalloc (GFP_KERNEL)", "\tkmalloc(4)", "xx kmalloc  (", "halt", "heeet", "ht", "hello hello", "hell", "q;", "Q:", "a:", "n:n", "K", "k", "K", "ſ", "s", "S",
    "STACK_x", "stack_", "À-ÿ", "ÀÐ9Ð", "[x]", "a&&b", "a^b", "{", "a{2", "aa", "aaa", "A.b.C", "0123456789abcdef0123", "dead-beef", "é", "日本語 text", "😀 smile 😀", "a\tb", "x" * 60, "one two  three", "def ghi", "__do", "errno=1", "(paren)", "back\\slash", "$5.00", "a|b", "tail ", "a]b", "a-b", "z9_", "_", "é", "ß",
]
PATTERNS = [
    "foo.$", "foo$", r"\s", r"\S\s\S", r"\bx", r"a\b", r"\B", r"\w", r"\W", r"\d{2}", r"\D$", "[[:alpha:]]", "[[:^alpha:]]", "[^[:space:]]", "[[]", "[]a]", "[^]a]", "[a&&b]", "[a^]", "[-a]", "[a-]", r"[\w-]", r"[\]\\]", r"[\s\S]", "a{2}", "a{2,}", "a{,2}", "{", "a{", "a{2", "x*", "x+?", "(?:ab|a)b?", "(a)(b)?", "h(al|e*)t", "hello{0}",
    r"^(\s.*\S)?kmalloc\s*\(", r"errno\W", "____do", "([a-e]:)|[g-k]", "(([a-e]:)|[a-e])n", "([aA]|[bB])c", "[sS][tT][aA][cC][kK]_", "[À-ÿ]", "[À-Ð]{2}", "[0-9À-Ð]{4}", r"\x61", r"\x{e9}", r"\pL", r"\p{Lu}", r"\PL", r"\p{Greek}", "[^a]", "[^a-zé]", ".", "..", "^", "$", "^$", "a|", "|a", "()", "(|x)y?", r"\.", r"\$", r"\{", "[$.]", "é", "日.", "😀", "[😀é]", r"\Qa.b\E", r"a\z", r"\Aa", "(?i:k)", "(?i)s", "k(?i)S|ſ", "[0-9a-f]{20}", r"\s{10}$", "(?P<n>o)n", "(?s).", "(?m)^a", "tail $",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").cache()


@pytest.mark.parametrize("fold", [False, True])
def test_matches_and_bounds_agree_with_the_linear_engine(spark, texts, fold):
    con = duckdb.connect()
    con.execute("CREATE TABLE texts (i INT, t VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?, ?)", list(enumerate(TEXTS)))
    compiled = [Pattern.compile(p, fold) for p in PATTERNS]
    got = texts.select("i", *[F.when(c.matches(F.col("t")), F.array_join(F.transform(c.bounds(F.col("t")), lambda x: x.cast("string")), "-")).alias(f"p{k}") for k, c in enumerate(compiled)]).orderBy("i").collect()
    wrong = []
    for k, p in enumerate(PATTERNS):
        flag = "i" if fold else ""
        sql = "SELECT i, CASE WHEN regexp_matches(t, $1) THEN length(regexp_extract(t, $2, 1)) || '-' || (length(regexp_extract(t, $2, 1)) + length(regexp_extract(t, $2, 2))) END FROM texts ORDER BY i"
        want = con.execute(sql, [f"(?s{flag}-s){p}" if flag else p, f"(?s{flag})^(.*?)(?-s:({p}))"]).fetchall()
        wrong += [(p, TEXTS[i], w, got[i][f"p{k}"]) for i, w in want if w != got[i][f"p{k}"]]
    assert wrong == []


@pytest.mark.parametrize("p", ["(", ")", "a)", "[", "[a", "*", "+a", "a**?+(", "(?=a)", "(?!a)", "(?<=a)b", "(?>a)", r"\1", r"(a)\1", r"\G", r"\h", r"\R", "a{2,1}", "a{1001}", "[b-a]", "[[:nope:]]", "\\", "(?P<1>a)", r"\x{110000}", "(?z)"])
def test_rejected(p):
    with pytest.raises(QueryError):
        parse(p)


def test_measures_and_guards():
    assert width(parse("a(b|cd)e{3}")) == 6 and width(parse("x*")) == 1 and width(parse("[ab]{10}")) == 10
    assert program_size(parse("a{100}")) >= 100
    guard([parse("[0-9a-f]{200}")], "query")
    with pytest.raises(QueryError):
        guard([parse("[0-9a-f]{201}")], "query")
    with pytest.raises(QueryError):
        guard([parse("((a{20}){20}){20}")], "file", None)
    assert can_be_empty(parse("a*|b")) and not can_be_empty(parse("a+b*"))
    assert quote("a.b(c)[d]{e}^$|?*+\\") == r"a\.b\(c\)\[d\]\{e\}\^\$\|\?\*\+\\"


def test_chains(spark):
    assert len(chain(parse("a.*b.*c[de].*f"))) == 4 and chain(parse("a.*b*.*c")) is None and chain(parse("a.*b")) is None
    con = duckdb.connect()
    texts = ["axbxcxbxc", "abc", "acb", "xxaxxbbccxx", "cba", "", "aabbccaabbcc", "bca bca"]
    p = Pattern.compile("a.*b.*c", False)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.m, r.b if r.m else None) for r in df.select("t", p.matches(F.col("t")).alias("m"), p.bounds(F.col("t")).alias("b")).collect()}
    for t in texts:
        m, left, hit = con.execute("SELECT regexp_matches($1, 'a.*b.*c'), length(regexp_extract($1, '^(.*?)(a.*b.*c)', 1)), length(regexp_extract($1, '^(.*?)(a.*b.*c)', 2))", [t]).fetchone()
        assert got[t] == (m, [left, left + hit] if m else None)


def test_the_slow_chain_ends(spark):
    p = Pattern.compile(".*".join("abcdefghijklmnopqrss"), False)
    line = "abcdefghijklmnopqr" * 50
    assert spark.createDataFrame([(line,), (line + "ss",)], "t string").where(p.matches(F.col("t"))).count() == 1


NEEDS = [
    ("abc", "'abc'"), ("a", "anything"), ("abc|de", "('abc' or 'de')"), ("abc|d", "anything"), ("ab+cd", "('ab' and 'bcd')"), ("abc.*def", "('abc' and 'def')"), ("x*abc", "'abc'"), ("[ab]cd", "('acd' or 'bcd')"), ("hello{0}", "'hell'"), ("(foo|bar)+", "('bar' or 'foo')"), ("[0-9a-f]{8}", "anything"), (r"^\s*kmalloc\(", "'kmalloc('"),
]


@pytest.mark.parametrize("pattern, want", NEEDS)
def test_needs(pattern, want):
    assert planner.show(planner.need_of(parse(pattern))) == want


def test_folded_needs_avoid_letters_with_partners():
    assert planner.show(planner.need_of(parse("abc", True))) == "'abc'/i"
    assert planner.show(planner.need_of(parse("task", True))) == "'ta'/i"
    e = planner.explain("h(al|e*)t", False)
    assert e["width"] == 4 and "digraph" in planner.to_dot(planner.need_of(parse("abc|def")))


def holds(need, text):
    if need.kind == "any":
        return True
    if need.kind == "lit":
        return need.text in (text.lower() if need.fold else text)
    return (all if need.kind == "and" else any)(holds(p, text) for p in need.parts)


_piece = st.sampled_from(["a", "b", "ab", "c", ".", "[ab]", "[^a]", "(a|bc)", "(?:ab)+", "c*", "b?", "a{2}", "a{1,3}", "(b|)", "^", "$", r"\w", "(ab|cd)c"])


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(_piece, min_size=1, max_size=5), st.text("abcdABC ", max_size=14), st.booleans(), st.booleans())
def test_the_planner_never_excludes_a_match(pieces, text, fold, alt):
    pattern = ("|" if alt else "").join(pieces)
    con = _con()
    if con.execute("SELECT regexp_matches($1, $2)", [text, ("(?i)" if fold else "") + pattern]).fetchone()[0]:
        assert holds(planner.need_of(parse(pattern, fold)), text)


_held = []


def _con():
    if not _held:
        _held.append(duckdb.connect())
    return _held[0]


@pytest.mark.parametrize("fold", [False, True])
def test_the_linear_form_of_every_pattern(spark, texts, fold, monkeypatch):
    """The engine for risky patterns against the JVM's, on all patterns."""
    from quarry.operators import search

    compiled = [Pattern.compile(p, fold) for p in PATTERNS]
    shown = lambda c: F.when(c.matches(F.col("t")), F.array_join(F.transform(c.bounds(F.col("t")), lambda x: x.cast("string")), "-"))
    jvm = [shown(c) for c in compiled]
    monkeypatch.setattr(search.Pattern, "linear", True)
    for at in range(0, len(compiled), 16):
        some = range(at, min(at + 16, len(compiled)))
        rows = texts.select("t", *[jvm[k].alias(f"a{k}") for k in some], *[shown(compiled[k]).alias(f"b{k}") for k in some]).collect()
        assert [(PATTERNS[k], r.t, r[f"a{k}"], r[f"b{k}"]) for r in rows for k in some if r[f"a{k}"] != r[f"b{k}"]] == []


def test_negated_classes_fold_first(spark):
    con = duckdb.connect()
    patterns = ["[[:^alpha:]]", "[[:^upper:]]", r"[\W]", r"[\Wk]", "[^[:^lower:]]", r"\W"]
    texts = ["a", "K", "k", "\u212a", "\u017f", "1", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        got = {r.t: r.m for r in df.select("t", Pattern.compile(p, True).matches(F.col("t")).alias("m")).collect()}
        assert got == {t: con.execute("SELECT regexp_matches($1, $2)", [t, f"(?i){p}"]).fetchone()[0] for t in texts}, p
