import pytest

from quarry.functions.regex import QueryError
from quarry.plans.query import Query, effective_context, effective_limit, from_params, parse

R, L = True, False
CASES = [
    ("hello", R, dict(line="hello", fold_case=True)),
    ("a b c", R, dict(line="a b c", fold_case=True)),
    (" a  ", R, dict(line="a", fold_case=True)),
    ("line file:.rb", R, dict(line="line", file=(".rb",), fold_case=True)),
    ("( a  )", R, dict(line="( a  )", fold_case=True)),
    ("Aa", R, dict(line="Aa")),
    ("case:abc", R, dict(line="abc")),
    ("case:abc file:^kernel/", R, dict(line="abc", file=("^kernel/",))),
    ("case:abc file:( )", R, dict(line="abc", file=("( )",))),
    ("(  () (   ", R, dict(line="(  () (", fold_case=True)),
    (r"a file:\(", R, dict(line="a", file=(r"\(",), fold_case=True)),
    (r"a file:(\()", R, dict(line="a", file=(r"(\()",), fold_case=True)),
    ("(", R, dict(line="(", fold_case=True)),
    ("(file:)", R, dict(line="(file:)", fold_case=True)),
    ("re tags:kind:function", R, dict(line="re", tags="kind:function", fold_case=True)),
    ("-file:Godep re", R, dict(line="re", not_file=("Godep",), fold_case=True)),
    ("-file:. -repo:Godep re", R, dict(line="re", not_file=(".",), not_repo="Godep", fold_case=True)),
    ("-tags:kind:class re", R, dict(line="re", not_tags="kind:class", fold_case=True)),
    ("case:foo:", R, dict(line="foo:")),
    ("lit:.", R, dict(line=r"\.")),
    ("std::string", R, dict(line="std::string", fold_case=True)),
    ("a max_matches:100", R, dict(line="a", max_matches=100, fold_case=True)),
    ("a max_matches:", R, dict(line="a", fold_case=True)),
    ("file:hello", R, dict(line="hello", file=("hello",), filename_only=True, fold_case=True)),
    ("file:HELLO", R, dict(line="HELLO", file=("HELLO",), filename_only=True)),
    ("lit:a( file:b", R, dict(line=r"a\(", file=("b",))),
    ("lit:a(b file:c", R, dict(line=r"a\(b", file=("c",))),
    (r"[(] file:\.c", R, dict(line="[(]", file=(r"\.c",), fold_case=True)),
    (r"[ ] file:\.c", R, dict(line="[ ]", file=(r"\.c",), fold_case=True)),
    (r"[ \]] file:\.c", R, dict(line=r"[ \]]", file=(r"\.c",), fold_case=True)),
    ("a( file:b", L, dict(line=r"a\(", file=("b",), fold_case=True)),
    ("a (file:b", L, dict(line=r"a \(file:b", fold_case=True)),
    ("(file:a b", L, dict(line=r"\(file:a b", fold_case=True)),
    ("(file:a) b", L, dict(line=r"\(file:a\) b", fold_case=True)),
    ("(file:a repo:b", L, dict(line=r"\(file:a repo:b", fold_case=True)),
    ("(file:a) repo:b", L, dict(line=r"\(file:a\)", repo="b", fold_case=True)),
    ("(file:a) (repo:b)", L, dict(line=r"\(file:a\) \(repo:b\)", fold_case=True)),
    ("file:a( b", L, dict(line="b", file=(r"a\(",), fold_case=True)),
    (r"file:a file:b path:c path:\.rb$ zoo", R, dict(line="zoo", file=("a", "b", "c", r"\.rb$"), fold_case=True)),
    (r"-file:a -path:b -file:c -path:\.rb$ zoo", R, dict(line="zoo", not_file=("a", "c", "b", r"\.rb$"), fold_case=True)),
]


@pytest.mark.parametrize("text, regex, want", CASES)
def test_parse(text, regex, want):
    assert parse(text, regex) == Query(**want)


@pytest.mark.parametrize("text", ["case:a b", "lit:a b", "case:a lit:b", "a max_matches:a", "a file:b c", "a file:((abc()())()) c", "a repo:b repo:c", "a -repo:b -repo:c"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_parameters():
    assert from_params({"line": ["a.b"], "regex": ["false"]}).line == r"a\.b"
    q = from_params({"q": ["x"], "file": ["f1", "f2"], "repo": ["r"], "repo[]": ["other"], "fold_case": ["auto"]})
    assert q.file == ("f1", "f2") and q.repo == "r" and q.repos == () and q.fold_case
    assert from_params({"q": ["x"], "repo[]": ["a", "b"]}).repos == ("a", "b")
    assert from_params({"q": ["x"]}, 9).max_matches == 9
    with pytest.raises(QueryError):
        from_params({"q": [""]})


def test_defaults():
    assert effective_limit(Query()) == 50 and effective_limit(Query(max_matches=-1)) is None and effective_limit(Query(max_matches=3)) == 3
    assert effective_context(Query()) == 3 and effective_context(Query(context_lines=5)) == 5
