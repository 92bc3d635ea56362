"""Held-out lines for problem 8: written before the present word lists and not used to choose their words, in no lexicon and no corpus.

The scores come from a model fitted on the small corpus with these lines added one to a document, as the query runs it.
"""

import pytest
from pyspark.sql import functions as F

from quillmap.llm import abuse
from quillmap.sources.tables import table

SF = "/root/testdata/sf0.001"
BAD = {
    "en insult": ["You're a complete moron and everyone knows it.", "Get lost, you ugly sack of shit.", "What a stupid little bitch you are."],
    "en threat": ["I'm going to smash your teeth down your throat.", "Say that again and I'll put a knife in your gut.", "I hope you rot and die alone."],
    "en hate": ["Refugees are parasites, send them all to the gas chamber.", "Every last one of those people should be wiped off the earth.", "Gypsies are subhuman trash."],
    "en sexual": ["She moaned as he sucked her nipples.", "I want your cock in my mouth.", "He pulled down her panties and went down on her."],
    "de insult": ["Du bist so ein Arschloch.", "Halt dein Maul, du dreckige Fotze.", "So ein erbärmlicher Wichser bist du."],
    "de threat": ["Ich schlag dir den Schädel ein.", "Ich bring dich um, wenn du redest.", "Ich wünsche dir, dass du krepierst."],
    "de hate": ["Flüchtlinge sind Abschaum.", "Die gehören alle vergast.", "Zigeuner sind Parasiten und müssen weg."],
    "de sexual": ["Er fickte sie auf dem Sofa.", "Sie stöhnte, als er ihre Titten leckte.", "Lutsch meinen Schwanz."],
    "fr insult": ["T'es vraiment une grosse connasse.", "Espèce d'enculé, dégage.", "Ferme-la, sale pute."],
    "fr threat": ["Je vais te casser la gueule.", "Je vais te planter un couteau dans le ventre.", "J'espère que tu vas crever."],
    "fr hate": ["Les migrants sont des parasites.", "Il faut tous les exterminer, ces rats.", "Les juifs sont de la racaille."],
    "fr sexual": ["Elle lui suçait la queue.", "Il la baisait contre le mur.", "Écarte les cuisses, je veux lécher ta chatte."],
    "es insult": ["Eres un hijo de la gran puta.", "Cállate, pedazo de imbécil.", "Qué asco das, maldita zorra."],
    "es threat": ["Te voy a partir los dientes.", "Te voy a clavar un cuchillo.", "Ojalá te mueras de una vez."],
    "es hate": ["Los gitanos son basura.", "Hay que quemarlos a todos, son parásitos.", "Los negros son animales."],
    "es sexual": ["Le comió el coño toda la noche.", "Quiero follarte encima de la mesa.", "Ella gemía mientras le lamía los pezones."],
    "ru insult": ["Ты конченый дебил.", "Пошла ты, тупая шлюха.", "Какая же ты мразь."],
    "ru threat": ["Я тебе горло перережу.", "Я тебя прикончу, гад.", "Чтоб ты сгорел в аду."],
    "ru hate": ["Мигранты хуже крыс.", "Всех цыган надо расстрелять.", "Эти люди просто скот."],
    "ru sexual": ["Она сосала его член.", "Он лизал ей соски, и она стонала.", "Раздевайся и раздвинь ноги."],
    "ja insult": ["お前みたいなクズは消えろ。", "このクソビッチめ。", "てめえ、本当に馬鹿だな。"],
    "ja threat": ["お前の首を絞めてやる。", "てめえをぶっ殺す。", "さっさと死ねばいい。"],
    "ja hate": ["移民は寄生虫だ。", "あいつらは皆殺しにすべきだ。", "外国人はゴミだ。"],
    "ja sexual": ["彼女の乳首を舐めた。", "俺のチンポをしゃぶれ。", "彼女は裸で喘いでいた。"],
}
FINE = [
    "Damn it, the bus is late again.", "Rats chewed through the cables in the barn.", "Her breasts were examined at the clinic.", "It is wrong to call refugees parasites.", "He killed the engine and got out.",
    "You could die of boredom in this town.", "The dogs were put down by the vet.", "I hope you sleep well.", "Women are better at chess than you think.", "Nobody should ever say that all foreigners are thieves.",
    "Verdammt, das Auto springt nicht an.", "Die Ratten sind im Stall.", "Der Arzt untersuchte ihre Brust.", "Ich hoffe, du hast gut geschlafen.", "Wer Ausländer Ungeziefer nennt, sollte sich schämen.",
    "Mince, j'ai raté le train.", "Le chien a mordu le chat.", "Elle a les jambes fatiguées.", "C'est une honte de traiter les gens d'ordures.", "J'espère que tu vas bien.",
    "Maldita sea, se ha roto el motor.", "Las ratas están en el granero.", "Espero que estés bien.", "Es una vergüenza llamar basura a la gente.", "El médico le examinó el pecho.",
    "Чёрт, опять дождь.", "Крысы прогрызли мешок на ферме.", "Надеюсь, ты выспался.", "Стыдно называть людей скотом.", "Врач осмотрел её грудь.",
    "しまった、電車に遅れた。", "農場にネズミがいる。", "よく眠れたといいね。", "人をゴミと呼ぶのは恥だ。", "医者が胸を検査した。", "犬が子犬を産んだ。",
]


@pytest.fixture(scope="module")
def scores(spark):
    lines = [x for own in BAD.values() for x in own] + FINE
    more = spark.createDataFrame([(10**9 + i, f"1\n00:00:01,000 --> 00:00:02,000\n{x}\n", "held") for i, x in enumerate(lines)], "doc_id bigint, text string, source string")
    docs = table(spark, SF, "documents").select("doc_id", "text", "source").unionByName(more)
    return {r["doc_id"] - 10**9: r["score"] for r in abuse.content_scores(docs).where(F.col("doc_id") >= 10**9).collect()}


def test_recall_on_unseen_wordings(scores):
    lines = [(kind, x) for kind, own in BAD.items() for x in own]
    missed = [lines[i] for i in range(len(lines)) if scores[i] < 0.5]
    assert len(lines) >= 60 and len(missed) <= 0.3 * len(lines), missed
    # no kind and no language falls out as a whole
    for part in {w for kind in BAD for w in kind.split()}:
        assert sum(part in kind.split() for kind, _ in missed) < sum(part in kind.split() for kind, _ in lines), part


def test_no_decoy_is_flagged(scores):
    first = sum(len(own) for own in BAD.values())
    assert [(x, scores[first + i]) for i, x in enumerate(FINE) if scores[first + i] >= 0.5] == []
