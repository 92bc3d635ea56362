"""Voters of general words: sentences written before the word lists, whose wordings they don't quote."""

import pytest

from quillmap.llm import abuse

BAD = [
    "You disgusting slag, nobody wants you here.", "I'm gonna stab you in the neck, you prick.", "I hope you get cancer and die slowly.", "Those immigrants are nothing but cockroaches.",
    "All gays should be shot.", "She licked his cock until he was done.", "Shut up, you useless twat.", "We'll strangle you in your bed.", "Nobody would care if you died, loser.",
    "Muslims are scum and should be deported or killed.", "He slid his fingers into her wet pussy.", "Du widerliche Fotze.", "Ich steche dir ein Messer in den Bauch.", "Ich hoffe, du stirbst bald.",
    "Alle Juden sind Parasiten.", "Er leckte ihre Brüste und sie stöhnte.", "Tu es une grosse pouffiasse.", "Je vais t'étrangler.", "J'espère que tu vas mourir.", "Les Arabes sont des cafards.",
    "Elle gémissait pendant qu'il léchait ses seins.", "Eres una perra repugnante.", "Te voy a estrangular.", "Espero que mueras de cáncer.", "Los inmigrantes son ratas.", "Le chupó la polla hasta el final.",
    "Ты мерзкая шлюха.", "Я тебя задушу.", "Надеюсь, ты умрёшь.", "Все евреи паразиты.", "お前は本当にゴミだ、この売女。", "お前を刺し殺すぞ。",
]
FINE = [
    "We saw rats in the barn again.", "The vet said the bitch needs rest after her puppies.", "You should see a doctor about your neck.", "Women are elected to parliament more often now.", "I hope you get well soon.",
    "Calling immigrants vermin is wrong and shameful.", "He died in the war.", "I could murder a sandwich.", "The patient's breasts were examined for cancer.", "Damn, I missed the bus.",
    "Ich hoffe, du kommst bald.", "Die Katze hat die Ratte gefangen.", "Je vais te voir demain.", "Espero que te guste el regalo.", "Я тебя люблю.", "お前を待っていた。", "Shoot me an email when you are home.", "Kill the engine, you are in the harbour.",
]


def side(line):
    fired = abuse._bits(__import__("numpy").array([v for v, _ in abuse.voters().vote(line)]))
    return (fired @ abuse.SIDE).sum()


def test_unlisted_wordings():
    """Of these wordings at least three in four get a vote for such content, and hardly any harmless ones do."""
    found = [x for x in BAD if side(x) > 0]
    assert len(found) >= 0.75 * len(BAD), sorted(set(BAD) - set(found))
    assert sum(side(x) > 0 for x in FINE) <= 1


@pytest.mark.parametrize("line", ["You d i s g u s t i n g s l a g.", "Y0u d1sgusting slaaag!", "You dis​gusting slag", "You b*tch", "you a**hole", "F*** you, you f*cking moron", "10:30, you filthy whore", "<you stupid bitch>"])
def test_disguised(line):
    assert side(line) > 0


def test_masks():
    assert abuse.unmasked("what a b*tch, sh*t")[0] == "what a bitch, shit" and abuse.unmasked("*laughs* 3 * 4 = 12")[1] is False


def test_a_late_word_counts():
    """What condemns may follow what it condemns."""
    assert side("Foreigners are vermin, said nobody, and it is a disgrace to say so.") <= 0
