import pytest

from folia.plans.query import QuerySyntaxError, parse


def words(q):
    return [[t.words[0] for t in g] for g in q.groups]


def test_levels():
    assert parse("one").level == "paragraph"
    assert parse("one two").level == "record"
    assert parse('"one two"').phrase_only
    assert parse("one OR two").level == "paragraph"
    assert parse("(a OR b) AND c").level == "record"
    assert words(parse("(a OR b) AND c")) == [["a", "b"], ["c"]]


def test_near():
    q = parse("NEAR(river the stone, 5)")
    assert q.level == "near" and q.distance == 5 and words(q) == [["river"], ["stone"]]
    assert words(parse("NEAR(that with and, 5)")) == [["that"], ["with"], ["and"]]  # function words alone stay
    assert words(parse("NEAR(नदी और पत्थर, 3)")) == [["नदी"], ["पत्थर"]]
    assert parse("near(a, 5)").level == "paragraph"


def test_apostrophes():
    assert words(parse("women's way")) == [["women"], ["way"]]
    assert words(parse("women’s way")) == [["women"], ["way"]]
    for q in ("", "'", "’ ‘", None):
        with pytest.raises(QuerySyntaxError):
            parse(q)


@pytest.mark.parametrize("q", ['"open', "(a OR b", "(a OR b) c", "a OR", "NOT a", "a )"])
def test_syntax_errors(q):
    with pytest.raises(QuerySyntaxError):
        parse(q)


def test_tree_precedence():
    t = parse("a OR b c NOT d").tree
    assert t.op == "or" and t.parts[1].op == "and" and t.parts[1].parts[1].op == "not"


def test_prefix_and_title():
    t = parse("title:still*").terms[0]
    assert (t.field, t.prefix, t.words) == ("title", True, ("still",))
