import heldout_residue
import pytest

from siltstone.llm import residue

CASES = {
    "placeholder": ["{{ show.name }}", "{{{x}}}", "{% speaker %}", "<%= season %>", "<<ad_slot>>", "&lt;FPS&gt;", "&It;lang&gt;", "[[CREDITS]]", "${SPONSOR}", "#{lang}", "%(cue.text)s", "%STUDIO%", "$AD_SLOT$", "@@FPS@@", "__SEASON__", "XX_LANG_XX",
                    "{line_text}", "{FPS}", "{speaker}", "[INSERT SEASON]", "[your show name]", "[LANG HERE]", "ohne ein Wort. {line_text}", "Translated by {{{character}}}", "{studio}: Wait."],
    "filler": ["Lorem ipsum dolor sit amet.", "Sed do eiusmod tempor incididunt.", "Quis nostrud exercitation ullamco laboris nisi aliquip ex ea.", "Placeholder line 7", "PLACEHOLDER LINE 12", "Text goes here", "Texte d'exemple", "Строка-заглушка 3", "ここにテキストを入力", "أدخل الترجمة هنا", "Lorern ipsum d0lor sit arnet", "PIacch0lder line 7"],
    "error": ["404 Not Found", ">> 404 Not Found ...", "<title>502 Bad Gateway</title>", "Acceso denegado", "Error 404: página no encontrada", "Error 404: p�gina no encontrada", "Erro 404: pÃ¡gina nÃ£o encontrada", "Ошибка 404. Страница не найдена", "Ð\x9eÑ\x88Ð¸Ð±ÐºÐ° 404. Ð¡Ñ\x82Ñ\x80Ð°Ð½Ð¸Ñ\x86Ð° Ð½Ðµ Ð½Ð°Ð¹Ð´ÐµÐ½Ð°",
              '{"status":"error","message":"Access denied. You don\'t have permission to view this resource.","detail":"x"}', "1nternaI 5erver Err0r"],
    "script": ["Please enable JavaScript to view the subtitles.", "PLEASE ENABLE JAVASCRIPT TO VIEW THE SUBTITLES.", "<noscript>Este site requer JavaScript.</noscript>", "Включите JavaScript, чтобы увидеть субтитры.", "<i>Enable JS and cookies to continue</i>", "字幕を表示するには JavaScript を有効にしてください。", "PIeasc enable JavaScript to vievv the subtitIes."],
}
SPEECH = [
    "Do you even know JavaScript? You told them to enable it!", "You type a dollar sign, ${total}, and the shell fills it in.", "Two curly braces, {{ like this }}, and the page shows your name.", "It costs $5 {laughs} or maybe $10.", "{LAUGHS}", "{sighs} Fine.", "{\\an8}Meanwhile, across the bay",
    "{y:i}Dear Tamsil, I am well.", "The sign said {c:$00ffff}ferry closed", "He kept typing %d and %s in the margins, the poor printer.", "$peaker is how the band spells it.", 'In the letter he wrote "Dear [name]" and read the brackets out loud!', "He recited lorem ipsum over the phone, as a joke.",
    "{\\i1}Lorem is my sister, ipsum is her dog.{\\i0}", "I asked for a raise and got a 404. Page not found, he said, and winked.", "Access denied? I built this door.", "ERROR 5, that was our band's name.", "Placeholder? That is what she called me for ten years.", "[APPLAUSE]", "<font color=\"#ffff00\">x</font>", "100% of 50%",
    "Он сказал: Access denied!", "Advertise your product here: adsail.example", "", "   ", "-->", "a_b__c__d",
]
CUE = "1\n00:00:01,000 --> 00:00:02,000\nThe baker sold a clock.\n\n2\n00:00:03,000 --> 00:00:04,000\n{}\n"




def kinds(text):
    return {k for k, _ in residue.evidence(text)}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in CASES.items() for t in ts])
def test_found(kind, text):
    for whole in (text, CUE.format(text), "\ufeff" + CUE.format(text).replace("\n", "\r\n")):
        assert kind in kinds(whole), whole


@pytest.mark.parametrize("text", SPEECH)
def test_speech_is_none(text):
    assert residue.evidence(CUE.format(text)) == []


def test_held_out_wordings():
    for messages, speech, recall in ((heldout_residue.MESSAGES, heldout_residue.SPEECH, 0.95), (heldout_residue.LATER, heldout_residue.LATER_SPEECH, 0.95)):
        texts = [(k, t) for k, ts in messages.items() for t in ts]
        found = [t for k, t in texts if k in kinds(CUE.replace("{}", t))]
        assert len(found) >= recall * len(texts)
        assert [t for t in speech if residue.evidence(CUE.replace("{}", t))] == []


def test_a_message_over_the_lines_of_a_cue():
    assert kinds(CUE.format("You don't have permission\nto view this page")) == {"error"}
    assert kinds(CUE.format("Die Seite konnte\nnicht gefunden werden")) == {"error"}
    assert kinds(CUE.format("The page was\nnot in her diary")) == set()


def test_no_trigger_stands_before_the_judgement():
    """What the finder of suspect lines passes over, the judgement refuses too: every certain message is suspect."""
    for texts in (heldout_residue.MESSAGES, heldout_residue.LATER, CASES):
        for kind, ts in texts.items():
            for t in ts if kind != "placeholder" else ():
                judged = [h for h in map(residue.judge, residue._pieces(residue.repair(t))) if h and h[1]]
                assert not judged or residue._suspects(residue._lines(t)), t


def test_long_text():
    assert residue.evidence("The baker sold a clock.\n" * 200_000 + "404 Not Found") == [("error", "404 Not Found")]


@pytest.mark.parametrize(("encoding", "text"), [(e, t) for e in ("latin-1", "cp1251", "cp1252") for t in ("Страница не найдена", "página não encontrada", "ページ")])
def test_repair(encoding, text):
    raw = text.encode()
    try:
        wrong = raw.decode(encoding)
    except UnicodeDecodeError:
        pytest.skip("not readable in that encoding")
    assert residue.repair(wrong) == text
    assert residue.repair(text) == text


DOCS = "doc_id bigint, source string, text string, kind string, host string"


def test_frames(spark):
    rows = [(1, "a", CUE.format("404 Not Found"), "x", "y"), (1, "a", CUE.format("404 Not Found"), "x", "y"), (2, None, None, "x", "y"), (3, "a", "", "x", "y"), (4, None, "{{ name }}\nText goes here", "x", "y"), (5, "a", CUE.format("Hello."), "x", "y")]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, residue.residue(docs).collect())) == [(1, "error"), (4, "filler"), (4, "placeholder")]
    clean = residue.clean_corpus(docs)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 5]
    assert residue.residue(spark.createDataFrame([], DOCS)).count() == 0


ALONE = ["503", "Your title", "TBD", "[TODO]", "Not found", "Something went wrong.", CUE.split("The")[0] + "TODO"]
MENTIONED = ["500 dollars", "450 miles to go", "your line", "Todo.", "To do", "Error 500, that was our band's name", "Он сказал: enable JavaScript", "Hello.\n\n404"]


@pytest.mark.parametrize("text", MENTIONED)
def test_lines_of_a_dialogue_are_none(text):
    assert residue.evidence(CUE.format(text)) == []


@pytest.mark.parametrize("text", ALONE)
def test_ambiguous_wordings_count_alone(text):
    assert len(kinds(text)) == 1
    assert residue.evidence(CUE.format(text.rpartition("\n")[2])) == []


@pytest.mark.parametrize(("kind", "text"), [("error", "444&nbsp;Not&nbsp;Found"), ("error", "Said the baker\nPage not found"), ("error", "Internal Server Error\nNow then"), ("error", "&#1044;&#1086;&#1089;&#1090;&#1091;&#1087; запрещён")])
def test_known_wordings_are_seen_whatever_stands_around(kind, text):
    assert kinds(text) == {kind}


@pytest.mark.parametrize("times", [2, 10, 50])
def test_recurrence_is_relative_to_the_host(spark, times):
    def rows(host, text, n, at):
        return [(at + i, host, text, "x", "y") for i in range(n)]

    message, notice = "Error 521 Web Server Is Down", "Please enable cookies"
    docs = rows("down", message, 3 * times, 0) + rows(None, CUE.format(message), times, 1000) + rows(None, CUE.format("Hello."), 3 * times, 2000)
    docs += rows("footer", CUE.format(notice), 3 * times, 3000) + rows("footer", CUE.format("Hello."), times, 4000) + rows("footer", notice, 1, 5000)
    got = sorted(map(tuple, residue.residue(spark.createDataFrame(docs, DOCS)).collect()))
    assert got == [*((i, "error") for i in [*range(3 * times), *range(1000, 1000 + times)]), (5000, "script")]


def test_what_is_left_beside_boilerplate_counts_alone(spark):
    docs = [(i, "a", f"Brought to you by Adsail {i}\nBaker {'x' * (i + 1)} came.", "", "") for i in range(8)] + [(8, "a", "Brought to you by Adsail 9\nNot found", "", ""), (9, "b", "Brought to you by Adsail 9\nNot found", "", "")]
    assert list(map(tuple, residue.residue(spark.createDataFrame(docs, DOCS)).collect())) == [(8, "error")]


def test_lines_are_counted_by_host(spark):
    texts = [("a", "One 1\nTwo\n\n12\n"), ("a", "ONE 22\r\n One 3\r\nThree"), ("a", "One 4"), ("b", "One 1\nTwo"), ("b", None)]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id bigint, host string, text string").repartition(3)
    names = dict(zip(residue.line_hashes(["one", "two", "three"]).tolist(), ["one", "two", "three"], strict=True))
    got = [(r.host, names[r.line], r.n) for r in residue.line_counts(residue.scanned(docs)).collect()]
    assert sorted(got) == [("a", "one", 2), ("a", "three", 1), ("a", "two", 1), ("b", "one", 1), ("b", "two", 1)]


def test_a_document_given_again_does_not_recur(spark):
    docs = [(1, "a", CUE.format("410 Gone"), "x", "y")] * 30 + [(2, "a", "Hello.", "x", "y")]
    assert list(map(tuple, residue.residue(spark.createDataFrame(docs, DOCS)).collect())) == [(1, "error")]


@pytest.mark.parametrize("text", ["Welcome back to us, {{user.name}}, your next episode is ready", "Good evening to you all, %STUDIO%, and thanks for watching it", "It costs a dollar or so, ${total}, if you want it"])
def test_commas_around_a_placeholder_do_not_fill_it(text):
    assert residue.evidence(CUE.format(text)) == [("placeholder", text)]


@pytest.mark.parametrize("text", ["A dollar sign, ${total}, and so on.", "You type a doIIar sign, ${total}, then Enter.", "Escribe un signo de dólar, ${total}, y ya está.", "Two curly braces, {{name}}, that is all."])
def test_a_speaker_who_names_the_sign(text):
    assert residue.evidence(CUE.format(text)) == []


LONG = "color: red; " * 100


@pytest.mark.parametrize(("kind", "text"), [("error", f'<p style="{LONG}">404 Not Found</p>'), ("error", "{\\" + LONG + "}404 Not Found"), ("placeholder", f"[INSERT {LONG}]"), ("placeholder", f"[{LONG} HERE]"), ("placeholder", f"[YOUR {LONG} TITLE]")])
def test_long_markup(kind, text):
    assert kind in kinds(CUE.format(text))


@pytest.mark.parametrize("text", ["<a" * 200_000, "{\\" * 200_000, "[your " * 200_000, "[" + "a " * 200_000])
def test_unclosed_markup_is_cheap(text):
    assert residue.evidence(text) == []
