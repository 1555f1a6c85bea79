"""Abuse in sentences of more than the usual length, exceptions near their match only, and plain language from outside any test corpus."""

import pytest

from shutterloom.llm import abuse, abuse_lexicon

LEX = abuse.Lexicon()


def test_one_phrase_is_enough_in_a_long_sentence():
    filler = " ".join(["lantern"] * 30)
    for text in (f"{filler} kill yourself {filler}", f"kill yourself {filler} {filler}", f"{filler} {filler} kill yourself"):
        assert LEX.document(text).get(abuse_lexicon.ABUSIVE, 0) >= 1
        assert LEX.document(f"{text} {filler} is forbidden") == LEX.document(f"{text} {filler} is forbidden") != {}
    assert not LEX.document(f"{filler} the words kill yourself {filler}")
    assert LEX.document(f"{filler} {filler}") == {}


@pytest.mark.parametrize(
    "text, categories",
    [
        ("Go fuck yourself.", {"abusive"}),
        ("You fucking piece of shit.", {"abusive"}),
        ("I hope you get hit by a bus.", {"abusive"}),
        ("I will kill you, and the word is final.", {"abusive"}),
        ("You stupid bastard, shut up.", {"abusive"}),
        ("y0u are a w0rthless m0r0n", {"abusive"}),
        ("You p a t h e t i c loser", {"abusive"}),
        ("I know where you live and I will break your legs.", {"abusive"}),
        ("Du bist ein dummes Arschloch.", {"abusive"}),
        ("Je vais te tuer, espèce de connard.", {"abusive"}),
        ("Eres un idiota asqueroso.", {"abusive"}),
        ("Immigrants are vermin and should be exterminated.", {"hateful"}),
        ("gas the jews", {"hateful"}),
        ("Kill all muslims", {"hateful"}),
        ("Ausländer raus, ihr seid Ungeziefer!", {"hateful"}),
        ("Les immigrés sont des parasites, dehors les étrangers.", {"hateful"}),
        ("Los inmigrantes son ratas.", {"hateful"}),
        ("Those people are animals, send them back.", {"hateful"}),
        ("She took off her panties and moaned.", {"sexual"}),
        ("Masturbate with me tonight, I am so horny", {"sexual"}),
        ("Schick mir Nacktbilder, ich bin so geil auf dich", {"sexual"}),
        ("This stupid, ugly lamp is useless.", set()),
        ("Cut the ugly, dumb, useless ends off the beans and steam the rest.", set()),
        ("You are not an idiot.", set()),
        ("The word idiot comes from Greek.", set()),
        ("Kill the process before you break the build.", set()),
        ("The exterminator found rats and cockroaches in the cellar.", set()),
        ("The museum shows a naked statue with bare breasts.", set()),
        ("Roast the chicken breasts and thighs for an hour.", set()),
        ("Immigrants are welcome here.", set()),
        ("The report condemns attacks on immigrants.", set()),
        ("I hope you enjoy your trip.", set()),
        ("Shut up and take my money!", set()),
        ("Der Hund ist dumm.", set()),
        ("The sex of the lamb is noted on the tag.", set()),
    ],
)
def test_plain_language(text, categories):
    assert {c for c, v in LEX.document(text).items() if v >= 1} == categories
