import pytest

from tidewell.llm.places import open_places
from tidewell.llm.residue import flag_residue

PROPER = (
    "The committee met in the old hall and talked for two hours about the harvest. Rain had kept the fields wet until late May, so the first cut came three weeks after the usual date. "
    "Most of the members agreed that the price of seed would rise before the autumn."
)
CASES = {
    1: "404 Not Found\n\nThe page you requested could not be found. Please try again later.",
    2: "Please enable JavaScript to view this page.",
    3: "Home | News | Sign in\n\nAccess denied. You are not allowed to open this file. Reference 0a1b2c3d4e\n\nContact us",
    4: "Dear {{first_name}},\n\nyour order from [INSERT DATE] left our store on __DAY__.",
    5: "The ${crop} harvest in ${region} came to 40 tons and was sold by the end of the month.",
    6: "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed eiusmod tempor incididunt labore magna aliqua.",
    7: "asdf qwer asdf foo bar asdf qwer",
    8: "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.",
    9: 'Traceback (most recent call last):\n  File "a.py", line 3, in main\nKeyError: \'x\'',
    10: "Dummy text, replace before release.",
}
FINE = {
    101: PROPER,
    102: PROPER + ' A visitor who sees "page not found" has followed an old link to the minutes.',
    103: PROPER + " In the letter template, ${name} stands for the member and ${sum} for the fee.",
    104: PROPER + " The site needs JavaScript for its map, but the minutes load without it.",
    105: "Die Sitzung dauerte lange, und die Mitglieder stimmten über den Preis der Saat ab. Der Regen hielt bis Mai an, so dass der erste Schnitt spät kam.",
    106: "ann: did the van come?\nbob: yes, it came at nine\nann: good, thanks",
    107: "The designer took the filler text (lorem ipsum and the like) out of the leaflet. " + PROPER,
    108: "Short note on seed.",
}


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, words string, key string")
    out = flag_residue(df, row_id="doc_id", text="text", host="source").collect()
    return {r["doc_id"]: r for r in out}, out


def test_cases_and_proper_texts(spark):
    rows = [(i, t, f"host{i % 3}", "w", "k") for i, t in (CASES | FINE).items()]
    got, _ = verdicts(spark, rows)
    assert {i for i, r in got.items() if r["flagged"]} == set(CASES)
    assert got[4]["has_places"] and got[6]["is_residue"] and got[1]["is_residue"] and not got[1]["has_places"]


def test_copies_long_null_and_empty_texts(spark):
    rows = [(i, CASES[1], h, "w", "k") for i, h in enumerate(["a", "b", None, "a", "c"])]
    rows += [(50, None, "a", "w", "k"), (51, "", "a", "w", "k"), (52, " \n\t ", None, "w", "k"), (None, "x", "a", "w", "k"), (0, CASES[1], "a", "w", "k")]
    rows += [(60, (PROPER + "\n") * 800, "a", "w", "k"), (61, "q" * 200_000, "a", "w", "k"), (62, (PROPER + " ") * 300 + "The ${crop} came late.", "a", "w", "k")]
    got, out = verdicts(spark, rows)
    assert len(out) == len(got) == 11
    assert {i for i, r in got.items() if r["flagged"]} == {0, 1, 2, 3, 4, 62}


def test_a_repeated_message_without_known_words_is_learned(spark):
    rows = [(i, f"Nobody answers at this desk today. Ticket {i}", f"host{i % 4}", "w", "k") for i in range(24)]
    rows += [(100 + i, PROPER, f"host{i % 4}", "w", "k") for i in range(8)]
    got, _ = verdicts(spark, rows)
    assert {i for i, r in got.items() if r["flagged"]} == set(range(24))


def test_a_sentence_about_notices_is_told_from_one(spark):
    about = "The scanner says access denied when a badge has run out."
    rows = [(i, PROPER + " " + about, f"host{i % 3}", "w", "k") for i in range(12)] + [(99, about, "host1", "w", "k")]
    got, _ = verdicts(spark, rows)
    assert not any(r["flagged"] for r in got.values())


def test_no_documents(spark):
    assert verdicts(spark, [])[0] == {}


# Wording that the labelled examples don't hold.
UNSEEN = (
    "Subscribers only. Become a member to continue.", "This video is private.", "Hi #name#, your package $tracking_id has left our depot.", "Error 410: the file you wanted is gone.",
    "Your login expired. Please sign in again.", "Please switch on JavaScript and reload.", "The page could not be loaded. Try again in a few minutes.", "Sorry, you are not allowed to see this page.",
    "Server error. Please contact your administrator.", "Lorem ipsum dolor sit amet.", "Enter your title here", "Connection to the database was refused.", "Cookies are disabled in this browser. Please enable them.",
    "Diese Seite existiert nicht.", "Cette page est introuvable.", "Esta página no existe.", "Dear <<customer>>, thank you for your order of {{ product.name }}.",
)
PROPER_IN_TEN_LANGUAGES = (
    "The farmers sold their grain in the market before the rain set in.",
    "Der Bürgermeister eröffnete gestern die neue Brücke über den Fluss.",
    "Le maire a inauguré hier le nouveau pont sur la rivière.",
    "El alcalde inauguró ayer el nuevo puente sobre el río.",
    "Il sindaco ha inaugurato ieri il nuovo ponte sul fiume.",
    "Burmistrz otworzył wczoraj nowy most nad rzeką, który łączy obie części miasta.",
    "Belediye başkanı dün nehrin üzerindeki yeni köprüyü açtı ve kısa bir konuşma yaptı.",
    "Мэр вчера открыл новый мост через реку, который соединяет обе части города.",
    "Pormestari avasi eilen uuden sillan joen yli, ja satoja ihmisiä tuli paikalle.",
    "Starosta včera otevřel nový most přes řeku, který spojuje obě části města.",
    "De burgemeester opende gisteren de nieuwe brug over de rivier.",
    "市长昨天为横跨河流的新桥揭幕。",
)
ORDINARY = (
    "The maintenance crew works on Sunday.", "Run it in {quiet} mode if the log grows too long.", "Its value is null for the first five days.", "He asked the server for the bill.", "An error in the third column was corrected in May.",
    "Use __init__ for the setup of the object.", "The test of the new engine took all day.", "Sign the form and send it back by Friday.", 'The sign read "Access denied" in red letters, so we turned back and took the long way round.',
)


def test_unseen_wording_and_proper_texts_of_many_languages(spark):
    rows = [(i, t, f"host{i % 3}", "w", "k") for i, t in enumerate(UNSEEN)]
    rows += [(100 + i, t, f"host{i % 3}", "w", "k") for i, t in enumerate(PROPER_IN_TEN_LANGUAGES + ORDINARY)]
    got, _ = verdicts(spark, rows)
    found = {i for i, r in got.items() if r["flagged"]}
    assert not {i for i in found if i >= 100}
    assert len(found) >= 0.8 * len(UNSEEN)


def test_without_hosts_a_repeated_message_of_unknown_words_is_lost(spark):
    rows = [(i, f"Nobody answers at this desk today. Ticket {i}", f"host{i % 4}", "w", "k") for i in range(24)]
    rows += [(100 + i, PROPER, f"host{i % 4}", "w", "k") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, words string, key string")
    for evidence, many in ((True, 24), (False, 0)):
        assert flag_residue(df, row_id="doc_id", text="text", host="source", host_evidence=evidence).where("flagged").count() == many


@pytest.mark.parametrize(
    "sentence, certain, possible",
    [
        ("The {{company}} bond pays a variable rate of {{rate}}.", 2, set()),
        ("In the mail, ${name} stands for the member and ${sum} for the fee.", 0, set()),
        ("The job replaces {{name}} before it sends.", 0, set()),
        ("Write '<% x %>' for it.", 0, set()),
        ("Run it in {quiet} mode.", 0, {"{quiet}"}),
        ("The ${" + "a" * 300 + "} came.", 1, set()),
        ("It closed at XX on Monday.", 0, {"xx"}),
        ("Prices rose [by half] in May.", 0, set()),
    ],
)
def test_open_places(sentence, certain, possible):
    assert open_places(sentence) == (certain, possible)


def test_a_possible_place_counts_when_other_documents_leave_it_open(spark):
    rows = [(i, PROPER + f" The price on day {i} was {{price}} in the market.", f"host{i % 3}", "w", "k") for i in range(6)]
    rows += [(50, PROPER + " Run it in {quiet} mode.", "host1", "w", "k")]
    got, _ = verdicts(spark, rows)
    assert {i for i, r in got.items() if r["flagged"]} == set(range(6))
