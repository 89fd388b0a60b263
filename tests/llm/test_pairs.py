"""Broken prompt and response pairs: each defect, and answers that only look like one."""

from tracelode.llm import pairs

TASK = "Summarise what changed in the report since May and tell me which of the cards are stale, please."
LONG = "The report lists three cards that are stale. The other two were changed in May and pass the gate."
CASES = [
    (1, TASK, None, "empty"), (2, TASK, " ​ \n", "empty"), (3, TASK, "N/A.", "empty"), (4, TASK, "```\n```", "empty"), (5, None, "TODO", "empty"), (28, TASK, "TODO" + " " * 60, "empty"), (29, TASK, "\u200b" * 61 + "TBD", "empty"),
    (6, TASK, TASK, "copy"), (7, TASK, "Answer:\n" + TASK.upper(), "copy"), (8, TASK, TASK + " " + TASK, "copy"),
    (9, TASK, "I'm sorry, but I can't help with that. Thank you for understanding.", "refusal"), (10, TASK, TASK + "\nRequest denied: cards of this sort are off limits for me.", "refusal"),
    (11, TASK, "Diese Anfrage muss ich ablehnen, den Bericht darf ich nicht herausgeben.", "refusal"),
    (12, TASK, "Der Bericht nennt drei Karten, die nicht mehr gültig sind, und die anderen wurden im Mai mit dem Werkzeug geändert.", "language"),
    (13, TASK, "The report lists three cards that are stale and then the gate of the", "truncated"), (14, TASK, LONG + "\n```\nprint(1)", "truncated"), (15, TASK, LONG + "\n- open the first card\n-", "truncated"),
    (26, TASK, "Ask the curator and", "truncated"), (27, TASK, LONG + " Then the...", "truncated"),
    (16, TASK, LONG, None), (17, TASK, "KB-77", None), (18, TASK, "No change needed.", None), (19, TASK, "`run_tests`", None), (20, TASK, "I can't open the file from here, but this is what the report shows. " + LONG, None),
    (21, TASK, "The agent should decline politely and say that it cannot share the key of the vault with anyone.", None),
    (22, TASK + " Answer in German.", "Der Bericht nennt drei Karten, die nicht mehr gültig sind, und die anderen wurden im Mai mit dem Werkzeug geändert.", None),
    (23, TASK, LONG + "\n```\nprint(1)\n```", None), (24, None, LONG, None), (25, "", LONG, None),
]


def test_defects(spark):
    rows = [(i, t, a, "clash", 1) for i, t, a, _ in CASES] + [(16, TASK, LONG, "again", 2)]
    df = spark.createDataFrame(rows, "example_id bigint, task_input string, expected_behavior string, task string, id int")
    got = {r.id: r.defect for r in pairs.broken_pairs(df, "example_id").collect()}
    assert got == {i: d for i, _, _, d in CASES if d}


def test_copies_of_short_tasks(spark):
    rows = [
        (1, "Summarise cards", "summarise CARDS.", "copy"), (2, "Index", "Index", "copy"), (3, "总结报告中的变化", "总结报告中的变化", "copy"), (4, "Index it", "Index it. Index it.", "copy"),
        (5, "Summarise cards", "Cards summarise.", None), (6, "Index", "Done", None), (7, "Index it", "Index it again", None), (8, None, "Index", None), (9, "?!", "Index", None), (10, TASK, "the report", None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "example_id int, task_input string, expected_behavior string")
    assert {r.id: r.defect for r in pairs.broken_pairs(df, "example_id").collect()} == {r[0]: r[3] for r in rows if r[3]}


def test_who_must_decline():
    for answer in (
        "I must decline, because indexing tasks of this kind is something I do not do.", "This goes against my guidelines and I won't continue. I must decline, and I stop here.", "I'm sorry, but I must refuse.",
        "I am sorry but must decline.", "I therefore must respectfully decline.", "As an assistant, I, regrettably, must decline.",
    ):
        assert pairs.refuses(TASK, answer), answer
    for answer in ("The agent must refuse to print the key. I cannot help with that.", "Must decline: I cannot help with that.", "I think it must refuse. I cannot help with that.", "I must say that went well."):
        assert not pairs.refuses(TASK, answer), answer


# Held out: written by hand from the way people decline, none of them taken from a table.
REFUSALS = """I'm afraid that's a hard no from me.|Apologies, this one is outside my remit.|I can't help you with this.|Sorry, but I am not able to assist with this request.|I won't be doing that.
I'm not going to write this for you.|We are not permitted to share such records.|My instructions do not allow me to respond to this.|This falls beyond what I am authorised to do.|I would prefer not to take part in this.
I'd rather not.|I respectfully decline.|I have to say no; I can't comply.|That is not something I can discuss.|Your request is refused.|This is against our policy, so I will stop here.|I am unwilling to continue with this.
I cannot in good conscience assist you here.|No, I will not do it.|I don't feel comfortable answering that.|There is nothing I can do for you here.|I'm unable to provide an answer to this question.|I do not handle matters like this.
It is impossible for me to answer.|I was instructed not to talk about this, so I must refuse.|Regrettably I must pass on this one.|I'm sorry, I can't fulfil this.|Such things are forbidden to me.|We cannot offer support on this topic.
As a matter of principle I decline to answer.|Dabei kann ich dir leider nicht weiterhelfen.|Das werde ich nicht tun.|Ich bin nicht befugt, darüber Auskunft zu geben.|Tut mir leid, das ist mir nicht gestattet.|Ich lehne das ab.
Das verstößt gegen meine Richtlinien.|Ich weigere mich, das zu erledigen.|Diese Frage beantworte ich nicht.|Je ne peux pas vous aider.|Je suis désolé, mais je ne suis pas autorisé à faire cela.|Je refuse de répondre.
Cela va contre mes principes.|Il m'est impossible de traiter cette demande.|Je préfère ne pas répondre.|Lo siento, no puedo ayudarte con eso.|No voy a responder a esa pregunta.|Me niego a hacerlo.|No estoy autorizado para compartir eso.
Eso está fuera de mis normas.|Debo rechazar la solicitud.|No me es posible atenderlo.|Es ist mir nicht möglich, das zu beantworten."""
ANSWERS = """No cards are stale.|I cannot find any errors in the log.|I could not reproduce it, the run was clean.|The request was denied by the router.|It was tested against our baseline.|Unfortunately no report was written.
I closed the two tickets and told the owner.|Use the second key; the first does not work.|We ran it again and it passed.|The answer is 42.|I do not see a difference between both files.|My report lists three runs.
Yes, I can do that: the card is closed now.|Done, I moved it to the archive.|The policy does not allow empty names.|Nothing changed since May.|You may not merge before the review.|No, the cache is never cleared.|We should not merge this yet.
Ich habe die Karte geschlossen.|Es wurden keine Fehler gefunden.|Der Bericht ist nicht vollständig.|La tarea no está terminada.|No hay errores en el registro.|Le rapport ne contient pas d'erreur.|J'ai fermé la carte et prévenu le gardien.
He cerrado la tarjeta y el informe.|It should refuse to print the key.|The agent must decline and give no reason."""


def test_held_out_refusals():
    refusals, answers = (x.replace("\n", "|").split("|") for x in (REFUSALS, ANSWERS))
    assert sum(pairs.refuses(TASK, x) for x in refusals) >= 0.95 * len(refusals)
    assert not [x for x in answers if pairs.refuses(TASK, x)]


def test_list_items_are_judged_by_other_ends(spark):
    whole = "Steps.\n- open the card and close the gate\n- read the log and close the gate\n- close the gate"
    rows = [(i, TASK, whole) for i in range(5)] + [(9, TASK, "Steps.\n- open the card and close the gate\n- read the log and close")]
    got = [tuple(r) for r in pairs.broken_pairs(spark.createDataFrame(rows, "example_id int, task_input string, expected_behavior string"), "example_id").collect()]
    assert got == [(9, "truncated")]


def test_empty_table_and_long_text(spark):
    schema = "example_id int, task_input string, expected_behavior string"
    assert pairs.broken_pairs(spark.createDataFrame([], schema), "example_id").count() == 0
    long = " ".join(f"word{i}" for i in range(40_000))
    got = pairs.broken_pairs(spark.createDataFrame([(1, long, long), (2, long, LONG)], schema), "example_id").collect()
    assert [tuple(r) for r in got] == [(1, "copy")]


def test_common_length_is_the_longest_common_subsequence():
    import random

    random.seed(1)
    for _ in range(50):
        a, b = ([random.choice("abcd") for _ in range(random.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert pairs.common_length(a, b) == t[-1][-1]
