import pytest

from depguard.llm.residue import evidence, residue, without_residue

SHOWN = [
    ("slot", "{{ author_name }}"), ("slot", "\\title{${article.title}}"), ("slot", "DOI: [INSERT date HERE]"), ("slot", "%%RECEIVED_DATE%%"), ("slot", "\\caption{%(date)s}"), ("slot", "&lt;journal&gt;"), ("slot", "<SECTION HEADING>"),
    ("slot", "\\textbf{XX-TITLE-XX}"), ("slot", "{% block abstract %}{% endblock %}"), ("slot", "Your abstract goes here"), ("slot", "<p>@@VOLUME@@</p>"), ("slot", "<à compléter : titre>"), ("slot", "[Titel HIER EINFÜGEN]"),
    ("filler", "Lorem ipsum dolor sit amet consectetur"), ("filler", "xxxxxxxx"), ("filler", "bla bla bla bla bla bla bla"), ("filler", "foo bar baz qux"), ("filler", "This is dummy text. It only shows how."), ("filler", "XXXX XXXX XXXX"),
    ("error", "HTTP/1.1 403 Forbidden"), ("error", "<h1>500 Internal Server Error</h1>"), ("error", "Fehler 404: Seite nicht gefunden"), ("error", "ACCESS TO THIS ARTICLE WAS DENIED."), ("error", "Your session has expired."),
    ("script", "Please enable JavaScript to view this article."), ("script", "<noscript>JS is disabled. Formulas cannot be shown.</noscript>"), ("script", "Cette page nécessite Javascript."), ("script", "Bitte aktivieren Sie scripts, um diesen Artikel zu lesen."),
]
NOT_SHOWN = [
    "", "   ", "% {{ title }}", "% HTTP/1.1 404 Not Found", "  title={{Latent array and decoupled corrections}},", "For $\\langle f,g\\rangle$ and $[[x]]$ we use the convention, where $<x>$ is a mean.",
    "The template engine of X replaces each marker, e.g.\\ \\verb|{{name}}|, by a value.", "Our classifier separates filler prose, often called lorem ipsum, from real text.",
    "During the crawl 46 percent of requests returned status 404 and were retried once.", "Access was denied to 55 of the volunteers who failed the screening.", "An internal error of 7 units was assigned to the detector.",
    "We model the rate of server errors, such as 502 and 503 responses, as a process.", "Pages that ask the reader to enable scripts were counted as empty in our survey.", "The message ``page not found'' appeared in 72 of the logs and was removed.",
    "Insert the bound here to see that 61 steps of the scheme suffice.", "\\section{Introduction}", "<hr>", "<div id=\"root\"></div>", "\\[", "$X$", "[1]", "\\cite{foo}", "Figure~29 shows how", "% TODO: insert title here", "\\input{missing-file}",
    "y" * 300_000, "a " * 50_000 + "b", "{" * 3000,
]


@pytest.mark.parametrize("kind,line", SHOWN)
def test_shown(kind, line):
    assert evidence(line) == kind


@pytest.mark.parametrize("line", NOT_SHOWN)
def test_not_shown(line):
    assert evidence(line) is None


LONG = "a rather long description of what belongs in this place of the article, " * 8


@pytest.mark.parametrize("line", [f"[insert {LONG}here]", f"[Hier {LONG}hier einfügen]", "{% block abstract %}" + LONG + "{% endblock %}", '<p class="' + "x" * 400 + '">{{ title }}</p>'])
def test_slots_of_any_length(line):
    assert evidence(line) == "slot"


def test_small_hosts_are_looked_at_together(spark, scratch):
    note = "JavaScript is required to show comments."
    rows = [(i, f"Article {'n' * i} of a small host.\n{note}", f"h{i // 3}", None) for i in range(1, 40)] + [(100, note, "h1", None), (101, f"Words.\n{note}\n404 Not Found", "h2", None)]
    got = {r.doc_id: r.whole for r in residue(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "source", scratch).collect()}
    assert got == {100: True, 101: False}
    few = spark.createDataFrame(rows[:6], SCHEMA)  # too few to tell: each line counts
    assert residue(few, "doc_id", "text", "source", scratch).count() == 6


SCHEMA = "doc_id bigint, text string, source string, kinds string"


def test_residue(spark, scratch):
    frame = "Real content of this page, the {0} of many.\nPlease enable JavaScript to view comments.\n"
    rows = [(i, frame.format("n" * (i + 1)), "blog", None) for i in range(40)]
    rows += [(100, "Please enable JavaScript to view comments.", "blog", None), (101, frame.format("ninth") + "Error 404: Not Found\r\n", "blog", "k"), (102, None, "blog", None), (103, "", None, None)]
    rows += [(200, "\\begin{document}\r\\title{{{TITLE}}}\rText of an article here.\r\\end{document}", "a", None), (201, "% {{TITLE}}\nText.", "a", None), (202, "HTTP/1.1 410 Gone", None, None), (203, "Zugriff verweigert.\nZugriff verweigert.", "a", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in residue(df, "doc_id", "text", "source", scratch).collect()}
    assert set(got) == {100, 101, 200, 202, 203}  # what a host shows on every page is no evidence, unless nothing else is left
    assert got[101].kinds == ["error", "script"] and not got[101].whole and got[202].whole and got[100].whole and not got[200].whole
    assert without_residue(df, residue(df, "doc_id", "text", "source", scratch), "doc_id").count() == len(rows) - 5
    assert residue(df.limit(0), "doc_id", "text", "source", scratch).count() == 0


def test_string_keys(spark, scratch):
    df = spark.createDataFrame([("k", "HTTP/1.1 410 Gone", "h"), ("l", "fine words", "h")], "key string, text string, host string")
    assert [r.key for r in residue(df, "key", "text", "host", scratch).collect()] == ["k"]


def test_clean_corpus_has_whole_records(spark, small):
    from depguard.llm.queries import QUERIES

    docs = spark.read.parquet(f"{small}/documents.parquet")
    marked = {r.doc_id for r in QUERIES["p9_found"](spark, small).collect()}
    clean = QUERIES["p9_clean"](spark, small)
    assert clean.columns == docs.columns
    assert sorted(map(tuple, clean.collect()), key=str) == sorted((tuple(r) for r in docs.collect() if r.doc_id not in marked), key=str)
