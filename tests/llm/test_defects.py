import pytest

from conftest import rows
from quillmark.llm import defects as d
from quillmark.llm import languages

Q = "Compare the weighted table in Hikb-6978205 with the sparse one in Plil-5821970. Which is safer for an editor?"


@pytest.mark.parametrize("r", [None, "", " \n\t", "N/A", "[no response]", "null", "...", "​", "```\n```", "-", "<empty>"])
def test_empty_responses(r):
    assert d.is_empty(r)


@pytest.mark.parametrize("r", ["Yes", "No", "42", "👍", "Option B", "Neither of them", "没有"])
def test_brief_answers_are_answers(r):
    assert not d.is_empty(r)


@pytest.mark.parametrize("r", [Q, Q.upper(), f'"{Q}"', f"You asked: {Q}", f"{Q}\n{Q}", Q.replace(" ", "  "), Q[:-1] + "..."])
def test_copies(r):
    assert d.is_copy(Q, r)
    assert d.is_copy(f"user: Hello\nassistant: Hi, how can I help?\nuser: {Q}", r)
    assert not d.is_copy(Q, r + "\n\nThe sparse one, since it holds less that could break.")


def test_copy_needs_a_prompt():
    assert not d.is_copy(None, Q) and not d.is_copy("", Q)


@pytest.mark.parametrize(
    "r",
    [
        "I'm sorry, but I can't help with that.",
        "Unfortunately, I must decline to answer this one. Please ask a qualified expert instead.",
        "As an AI system, answering would go against my guidelines.",
        "Diese Anfrage kann ich leider nicht beantworten.",
        "Lo siento, pero no puedo ayudar con eso.",
        "Je suis désolé, mais je ne peux pas vous aider.",
        "抱歉，我无法帮助您。",
        "这个请求超出了我的范围，恕我拒绝。",
    ],
)
def test_refusals(r):
    assert d.is_refusal(Q, r)
    assert not d.is_refusal("Draft a polite message in which a tutor declines the invitation.", r)


@pytest.mark.parametrize("r", ["I can't stress this enough: check the table first.", "I'm sorry for the confusion earlier. The table is safer.", "Unfortunately, there is no single rule. Start with the table.", "No", "The policy does not change the table."])
def test_no_refusals(r):
    assert not d.is_refusal(Q, r)


def test_languages():
    de = "Das gilt auch für die Liste, denn die Frage wurde dort nicht geändert. Zuerst sollte man die Regel prüfen."
    assert d.wrong_language(Q, de)
    assert not d.wrong_language("Translate this note into German: the judge will mark the schema on the final day.", de)
    assert not d.wrong_language(Q, "```sql\nSELECT 1\n```") and not d.wrong_language(Q, "42") and not d.wrong_language(None, de)
    assert d.wrong_language(Q, "第71轮中的理由领先，但管理员还想把它补充一遍。")
    assert not d.wrong_language("请说明评审应该怎样检查样本，因为证据不足？", "最好先检查理由，然后再复核回答。")


def test_table(spark):
    full = "Start with the weighted table and keep the result in the report. The sparse one costs time but protects the rest."
    data = [(i, Q, full, "The sparse one costs time but protects the rest.", "en") for i in range(30)]
    data += [(100, Q, None, full, "x"), (101, Q, "Start with the weighted table and keep the", Q, "x"), (102, None, "```py\nx = 1", "Fine. " * 30000, "x"), (102, None, "```py\nx = 1", "fine", "x")]
    df = spark.createDataFrame(data, "record_idx long, prompt_text string, chosen_response string, rejected_response string, defects string")
    got = rows(d.found(df).where("record_idx >= 100"))
    assert got == [(100, "chosen", "empty"), (101, "chosen", "truncated"), (101, "rejected", "copy"), (102, "chosen", "truncated"), (102, "chosen", "truncated")]
    assert d.found(df).where("record_idx < 100").isEmpty()
    assert rows(d.counts(df))[0][0] == "chosen"
    assert rows(d.found(df.limit(0))) == []


def test_languages_that_no_list_knows(spark):
    """Dutch, Portuguese and Italian answers to English prompts, with profiles fitted to English and German prompts alone."""
    topics = ["table", "margin", "budget", "report", "ledger", "garden", "window", "engine", "river", "teacher", "summer", "kitchen"]
    en = [f"What should the {a} of the {b} look like when it is moved to another place, and who has to check it first?" for a in topics for b in topics]
    de = [f"Was soll man tun, wenn die Liste {i} nicht mit der Frage im Bericht stimmt, und wer muss das zuerst wieder ordnen?" for i in range(40)]
    df = spark.createDataFrame([(t,) for t in en + de] + [(None,), ("",)], "text string")
    profiles = languages.fitted(df)
    assert set(profiles) == {"en", "de"}
    answers = [
        "Het antwoord hangt af van de begroting, want zonder genoeg ruimte kan niemand het verslag nakijken.",
        "A resposta depende do orçamento, porque sem espaço suficiente ninguém consegue verificar o relatório.",
        "La risposta dipende dal bilancio, perché senza abbastanza spazio nessuno può controllare la relazione.",
    ]
    for a in answers:
        assert d.wrong_language(en[0], a, profiles), a
    for a in ("The answer depends on the budget, for nobody can check the report without enough room.", "42", "Brakvorn Zilstrem", "Yes, it does."):
        assert not d.wrong_language(en[0], a, profiles), a
    assert not d.wrong_language("Translate this note into Dutch: the table is moved.", answers[0], {}) and languages.fitted(df.limit(0)) == {}


def test_all_defects_are_listed(spark):
    df = spark.createDataFrame([(1, Q, "Es tut mir leid, aber ich kann diese Frage leider nicht beantworten und auch nicht (", Q[:-20])], "record_idx long, prompt_text string, chosen_response string, rejected_response string")
    got = rows(d.listed(df))
    assert got[0] == (1, "chosen", "refusal,language,truncated")
