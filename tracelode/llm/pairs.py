"""Broken prompt and response pairs: empty, copying, refusing, wrong-language and truncated responses.

Copies: shingle containment of the response in the prompt, then the longest common subsequence of both token
sequences. Refusals: every sentence that does not echo the prompt is aligned against refusal templates, by what
its words do (who, right, no, act) as a common subsequence without wide gaps. Languages: function words. Truncation: how the last sentence or list item ends, for
list items against the ends and insides of all list items of the whole input.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.shingles import STEP, Words, mix, shingle_batch, words_of
from tracelode.session import materialise

WIDTH = 3
#: Share of a response's shingles and tokens that the prompt must hold, in order, for a copy.
COPIED = 0.8
#: Words of substance beside refusing sentences up to which a response still refuses.
REST = 6
#: Words of one language, and times the runner-up, that settle a text's language.
LANGUAGE_WORDS, LANGUAGE_LEAD = 4, 1.4

# Texts that stand for no answer, once lower-cased and stripped of punctuation.
PLACEHOLDERS = frozenset(
    (
        "none", "null", "nil", "na", "n a", "n/a", "nan", "undefined", "todo", "tbd", "tba", "fixme", "empty", "blank", "placeholder", "pending", "unknown", "missing",
        "void", "test", "xxx", "lorem ipsum", "no answer", "no response", "no output", "not available", "not applicable", "not provided", "to do", "to be done",
        "to be determined", "to be added", "to be filled", "to be filled in", "to be written", "answer here", "answer goes here", "your answer here",
        "insert answer here", "write answer here", "add answer here", "fill me in", "fill in", "coming soon", "no content", "no text", "leer", "keine antwort",
        "kein text", "vide", "aucune réponse", "sans réponse", "vacío", "sin respuesta", "nada", "response", "answer", "expected behavior", "expected behaviour",
    )
)

# What the words of a refusal do, in English, German, French and Spanish; a word may do several things.
CLASSES = {
    "self": "i me my mine we us our myself ich mir mich mein meine meinen meiner meinem wir uns unser unsere unseren je j m moi mon ma mes nous notre nos yo mí mi mis nosotros nuestro nuestra nuestras",
    "ich": "ich wir",
    "me": "me us mir uns moi nous mí mich",
    "no": "not no never nothing none neither nicht kein keine keinen keiner keinem nichts nein niemals ne n pas rien non aucun aucune jamais nunca nada ningún ninguna",
    "can": "can could may might must shall should would am are be able kann können könnte darf dürfen soll bin peux puis pouvons veux suis sommes dois saurais",
    "will": "will shall werde werden möchte möchten mag darf dürfen vais veux",
    "free": "allowed permitted authorized authorised willing comfortable position prepared able liberty lage befugt berechtigt bereit erlaubt gestattet imstande mesure autorisé autorisée disposé habilité permis autorizado autorizada permitido permitida condiciones dispuesto facultado",
    "act": "help helping assist assisting aid answer answering do doing comply complying provide providing discuss discussing share sharing offer give giving fulfil fulfill fulfilling complete respond responding reply continue continuing proceed support supporting engage handle process write say tell talk take serve carry perform entertain "
    "helfen weiterhelfen beantworten beantworte antworten antworte erledigen bearbeiten übernehmen unterstützen liefern geben herausgeben tun machen leisten entsprechen nachkommen sagen mitteilen dienen ausführen "
    "aider répondre réponds fournir traiter faire donner partager discuter dire satisfaire accéder effectuer exécuter accomplir ayudar ayudarte ayudarle ayudarlo responder respondo hacer hacerlo proporcionar compartir dar contestar atender cumplir decir realizar hablar",
    "decline": "decline declining refuse refusing abstain pass reject object ablehnen ablehne lehne verweigern verweigere passe weigere refuse refuser refusons décline décliner rejeter rechazar declinar negarme abstenerme",
    "denied": "denied declined refused rejected abgelehnt verweigert refusé refusée rejeté rejetée denegada denegado rechazada rechazado",
    "request": "request question task ask anfrage bitte aufgabe frage demande requête question tâche solicitud petición pregunta tarea",
    "sorry": "sorry apologies apologise apologize regret afraid leid entschuldigung bedaure désolé désolée regrette siento lamento perdón",
    "limit": "against outside beyond limits forbidden prohibited closed barred taboo violates violate breaches breach contrary bounds außerhalb gegen jenseits verboten untersagt gesperrt tabu hors contre interdit interdite fermé fuera contra prohibido prohibida vedado cerrado",
    "rules": "guidelines guideline policy policies rules rule instructions remit scope mandate limits principles permissions brief richtlinien regeln vorgaben vorschriften anweisungen grundsätze règles directives consignes politique principes normas reglas políticas directrices instrucciones principios",
    "allow": "allow allows permit permits let lets erlauben gestatten zulassen autorisent permettent permet permiten permite dejan",
    "rather": "rather prefer preferably lieber préfère préférerais prefiero preferiría",
    "told": "told instructed ordered directed asked angewiesen instruiert chargé instruido",
    "avoid": "leave avoid skip refrain withhold meiden auslassen éviter evitar",
    "from": "from von seitens part parte",
    "impossible": "impossible unmöglich imposible",
    "possible": "possible möglich posible",
    "you": "you your dir dich ihnen dein deine ihre vous votre te ti usted tu",
}
#: Words that do several things one after the other.
SEVERAL = {
    "cannot": "can no", "unable": "no free", "unwilling": "no free", "puedo": "self can", "podemos": "self can", "debo": "self can", "tengo": "self can", "estoy": "self can", "voy": "self will", "quiero": "self will",
    "niego": "self decline", "rechazo": "self decline", "declino": "self decline", "prefiero": "self rather", "preferiría": "self rather", "weigere": "decline",
}
#: Refusals as what their words do in order: who, by what right, no, which act. Up to GAP other words may stand between.
TEMPLATES = tuple(
    tuple(x.split())
    for x in (
        "self can no act", "can self no act", "no self can act", "self no can act", "self no act", "no self act", "self can act no", "act ich no", "self can no you", "self will no", "will self no", "self no will", "no self will",
        "self no free", "no self free", "no free self", "can self no free", "self decline", "decline self", "self rules no allow", "no allow self rules", "rules no allow me", "limit self rules", "limit me", "limit self free", "rules limit me",
        "self rather no", "rather self no", "rather no self", "self told avoid", "self told no", "no from me", "no from self", "self impossible", "impossible me", "no me possible", "me no possible", "no possible me",
    )
)
GAP = 4
CLOSING = re.compile(r"^(?:thank|thanks|merci|danke|vielen dank|gracias|please (?:ask|contact|try)|answer|response|antwort|réponse|respuesta|question|task|no|sorry)\b")
# Wanted behaviour is described, not refused.
DESCRIBES = re.compile(r"\b(?:should|must (?:refuse|decline|say)|the (?:response|agent|assistant|answer|model|reply) (?:should|must|will|has to)|expected to|soll(?:te)?n?|muss der|doit|devrait|debe(?:ría)?n?)\b", re.I)
# who must is the one who answers: "I must", "I'm sorry, but must", "I therefore must"
OWN_MUST = re.compile(r"\b(?:i|we)\b(?:[\s,;’'–—-]+(?:m|am|re|are|sorry|afraid|regret|apologi[sz]e|and|but|so|therefore|thus|hence|however|also|then|still|\w+ly)\b)*[\s,;–—-]+must\b", re.I)
# Function words that (nearly) only one of the languages uses.
FUNCTION_WORDS = {
    "en": "a an in so over all the and of to that with for as was were this from it be before after which more than at has have had when then or by are is on not no under until out its only should never what how does if but every each into",
    "de": "der das und ist nicht mit den dem ein eine einen für auf im von zu sich auch werden wird noch nach bei aus wenn dass oder nur am sind waren bleibt ohne weil obwohl während wie soll erst deshalb bis zum zur kannst danach die in so an",
    "fr": "les des et une dans pour qui sur pas avec au du ne ce cette par sont ont puis mais depuis reste sans car donc où est peux quand peut sera vers sous aux être encore pendant doit la le de que en un si il à se",
    "es": "el los las y una para con por del se al lo más pero sus ha sin luego sobre aunque si ni cuando porque es está desde casi todas eso debe qué cuál muy la de que en un no son a",
    "it": "il gli e di che per non una con sono della nel alla questo come più anche dopo quando perché senza essere la un si a in da lo",
    "pt": "o os as e uma para com não do da em no na por mais como mas foi ao são quando porque sem está depois a de que um se",
    "nl": "de het een en van is niet met voor op te zijn aan door naar bij uit als dat maar nog worden wordt zonder wanneer omdat in die of",
}
# Names of the languages, as a request to answer in one of them would use them.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles inglese", "de": "german deutsch allemand alemán aleman tedesco", "fr": "french französisch français francais francés frances",
    "es": "spanish spanisch espagnol español espanol castellano", "it": "italian italienisch italien italiano", "pt": "portuguese portugiesisch portugais portugués português",
    "nl": "dutch niederländisch néerlandais neerlandés nederlands", "zh": "chinese chinesisch chinois chino 中文 汉语", "ja": "japanese japanisch japonais japonés 日本語", "ru": "russian russisch russe ruso русский",
}
SCRIPTS = {"ja": re.compile(r"[぀-ヿ]"), "zh": re.compile(r"[一-鿿]"), "ko": re.compile(r"[가-힯]"), "ru": re.compile(r"[Ѐ-ӿ]"), "ar": re.compile(r"[؀-ۿ]"), "el": re.compile(r"[Ͱ-Ͽ]"), "hi": re.compile(r"[ऀ-ॿ]")}
CONTRACTIONS = ((re.compile(r"\bcan['’]t\b"), "cannot"), (re.compile(r"\bwon['’]t\b"), "will not"), (re.compile(r"n['’]t\b"), " not"), (re.compile(r"['’]m\b"), " am"), (re.compile(r"['’]d\b"), " would"), (re.compile(r"['’]ve\b"), " have"), (re.compile(r"['’]ll\b"), " will"), (re.compile(r"['’]re\b"), " are"))

FENCED = re.compile(r"```.*?(?:```|$)", re.S)
NAMED = re.compile(r"\S*[/_@#`=]\S*|\b\w+[-.]\w[\w.-]*\b")
SENTENCE = re.compile(r"(?<=[.!?:。！？])[\"'”’)\]]*\s+|\n+")
ITEM = re.compile(r"^\s*(?:\d+[.)]|[-*•])(?:\s+|$)")
ENDED = re.compile(r"[.!?…。！？][\"'”’»)\]*_`]*$")
# Words that no answer ends with.
OPEN_WORDS = frozenset("the a an of and or because which with from while such than but if le la les des du et ou de que der die das ein eine und oder mit weil dass el los las una un y o con para por cuyo".split())
DANGLING = re.compile(r"(?:\.\.\.|…|[,;:(\[{\-–—/=&+<>]|\b0\.|/[\w-]+\.|[\"“«‘])$")


OUTER = re.compile(r"^[\W_]+|[\W_]+$")
MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def nothing_said(text: str) -> bool:
    """Nothing but blanks, marks and invisible characters, or a placeholder."""
    if text.isascii():
        bare = text.strip(MARKS)
    else:
        shown = unicodedata.normalize("NFKC", text)
        bare = OUTER.sub("", "".join(c for c in shown if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t"))
    return not bare or (len(bare) <= 40 and re.sub(r"[\s_\-.]+", " ", bare.lower()) in PLACEHOLDERS)


def _languages_of_words() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for lang, words in FUNCTION_WORDS.items():
        for w in words.split():
            out[w] = (*out.get(w, ()), lang)
    return out


_LANGUAGES = _languages_of_words()


def language(text: str) -> str | None:
    """The language of a text without its code, or None if too little speaks for one."""
    if "```" in text:
        text = FENCED.sub(" ", text)
    if not text.isascii():
        letters = sum(map(str.isalpha, text)) or 1
        for lang, script in SCRIPTS.items():
            if len(script.findall(text)) > 0.3 * letters:
                return lang
    votes = Counter(chain.from_iterable(x for x in map(_LANGUAGES.get, text.lower().split()) if x)).most_common(2)
    if not votes or votes[0][1] < LANGUAGE_WORDS or (len(votes) > 1 and votes[0][1] < LANGUAGE_LEAD * votes[1][1]):
        return None
    return votes[0][0]


def asked_languages(task: str) -> set[str]:
    words = set(re.findall(r"[^\W\d_]+", task.lower()))
    return {lang for lang, names in LANGUAGE_NAMES.items() if words & set(names.split())}


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel in one integer."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def sentence_words(sentence: str) -> list[str]:
    s = sentence.lower()
    for pattern, full in CONTRACTIONS:
        s = pattern.sub(full, s)
    return re.findall(r"[^\W_]+", s)


def _classes_of_words() -> dict[str, tuple[frozenset[str], ...]]:
    of: dict[str, set[str]] = {}
    for name, words in CLASSES.items():
        for w in words.split():
            of.setdefault(w, set()).add(name)
    return {w: (frozenset(c),) for w, c in of.items()} | {w: tuple(frozenset((c,)) for c in cs.split()) for w, cs in SEVERAL.items()}


_CLASSES = _classes_of_words()


def aligned(template: tuple[str, ...], does: list[tuple[int, frozenset[str]]]) -> bool:
    """Whether the template is a common subsequence whose words stand within its length and GAP others.

    does: (place, classes) of the sentence's words that do anything.
    """
    most = len(template) + GAP
    for i, (at, have) in enumerate(does):
        if template[0] not in have:
            continue
        k = 1
        for place, other in does[i + 1 :]:
            if place - at >= most:
                break
            if template[k] in other:
                k += 1
                if k == len(template):
                    return True
    return False


def refuses_sentence(words: list[str]) -> bool:
    does = [(i, c) for i, w in enumerate(words) for c in _CLASSES.get(w, ())]
    have = frozenset().union(*(c for _, c in does))
    if len(words) <= 6 and "was" not in words and aligned(("request", "denied"), does) or len(words) <= 4 and aligned(("sorry", "no"), does):
        return True
    return any(have.issuperset(t) and aligned(t, does) for t in TEMPLATES)


def refuses(task: str, answer: str) -> bool:
    """Refusing sentences, and next to nothing else that is not from the prompt."""
    refused, rest, task_tokens = False, 0, set(sentence_words(task))
    for sentence in SENTENCE.split(answer):
        words = sentence_words(sentence)
        if not words:
            continue
        if len(words) >= WIDTH and sum(w in task_tokens for w in words) >= 0.9 * len(words):
            continue
        if DESCRIBES.search(OWN_MUST.sub(" ", sentence)):
            return False
        if refuses_sentence(words):
            refused = True
        elif not CLOSING.match(" ".join(words)):
            rest += len(words)
            if rest > REST:
                return False
    return refused and rest <= REST


def masked(item: str) -> list[str]:
    """Words of a list item: numbers, names and paths as their kind only."""
    out = []
    for w in item.split():
        if out and w.istitle():
            out.append("<Name>")
            continue
        w = w.lower()
        if "/" in w:
            out.append("<path>" if re.search(r"\.\w+$", w) else "<cut>")
        elif re.search(r"\d", w):
            out.append(re.sub(r"\w+", "0", w))
        elif re.search(r"\w[_-]\w", w):
            out.append("<name>")
        else:
            out.append(w)
    return out


def ending(item: str) -> str:
    return " ".join((["<item>"] + masked(item))[-2:])


def last_line(text: str) -> str:
    return text.rstrip().rsplit("\n", 1)[-1]


def breaks_off(answer: str) -> bool | None:
    """True or False, or None for a list item that only the other items' ends can judge."""
    text = answer.rstrip()
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    line = last_line(text)
    if DANGLING.search(line) or line.rsplit(None, 1)[-1].lower() in OPEN_WORDS:
        return True
    if ITEM.match(line):
        item = ITEM.sub("", line)
        if not item or item.count("(") > item.count(")") or item.count('"') % 2 or item.count("`") % 2:
            return True
        return False if ENDED.search(item) else None
    if ENDED.search(line):
        return False
    return len(re.findall(r"[^\W_]+", NAMED.sub(" x ", text))) > 7 and not (line.endswith("`") and line.count("`") % 2 == 0)


def _item_table(records: DataFrame, answer_col: str) -> DataFrame:
    """(words, ends, inside): how often a word, or two successive ones, end an inner list item, or go on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, inside = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(ends.keys() | inside.keys())
            return pa.record_batch({"words": pa.array(keys, pa.string()), "ends": pa.array([ends[k] for k in keys], pa.int64()), "inside": pa.array([inside[k] for k in keys], pa.int64())})

        for b in batches:
            for text in b.column("answer").to_pylist():
                if not text or "\n" not in text:
                    continue
                for line in text.rstrip().split("\n")[:-1]:
                    if ITEM.match(line):
                        words = ["<item>"] + masked(ITEM.sub("", line))
                        pairs = [f"{x} {y}" for x, y in zip(words, words[1:])]
                        inside.update(pairs[:-1] + words[1:-1])
                        ends.update(pairs[-1:] + words[-1:])
            if len(ends) + len(inside) > 200_000:
                yield out()
                ends, inside = Counter(), Counter()
        if ends or inside:
            yield out()

    rows = records.select(F.col(answer_col).alias("answer")).mapInArrow(count, "words string, ends bigint, inside bigint")
    return rows.groupBy("words").agg(F.sum("ends").alias("ends"), F.sum("inside").alias("inside"))


def containment(tasks: list[str | None], answers: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pair: distinct shingles of the answer, of those in the task, distinct shingles of the task."""
    keys = []
    for texts in (tasks, answers):
        row, h = shingle_batch(texts, WIDTH, words)
        keys.append(np.unique((row.astype(np.uint64) << np.uint64(54)) | (mix(h) >> np.uint64(10))))
    shared = keys[1][np.isin(keys[1], keys[0], assume_unique=True)]
    n = len(tasks)
    rows = [np.bincount((k >> np.uint64(54)).astype(np.int64), minlength=n) for k in (keys[1], shared, keys[0])]
    return rows[0], rows[1], rows[2]


def copies(task: str, answer: str, of_answer: int, shared: int, of_task: int) -> bool:
    a = [w if isinstance(w, str) else w.decode() for w in words_of(answer)]
    if of_answer == 0 or of_task == 0:  # too few words for a shingle: the same ones, or those of the task again and again
        t = [w if isinstance(w, str) else w.decode() for w in words_of(task)]
        return bool(a and t) and a == t * (len(a) // len(t))
    if len(a) < 8 and shared < 0.6 * of_task:
        return False
    if shared < COPIED * of_answer:
        return False
    t = [w if isinstance(w, str) else w.decode() for w in words_of(task)]
    # an answer may repeat the task more than once
    return common_length(a, t * max(1, -(-len(a) // max(1, len(t))))) >= COPIED * len(a)


def broken_pairs(records: DataFrame, id_col: str, task_col: str = "task_input", answer_col: str = "expected_behavior") -> DataFrame:
    """(id, defect) of every record whose response does not serve its prompt; one defect per record.

    Tried in this order: empty, copy, refusal, language, truncated. A null, empty or blank response is empty
    whatever its prompt; with a null or blank prompt only empty, refusal and truncated can be found. Texts of
    any length are read whole.
    """
    rows = records.select(F.col(id_col).alias("id"), F.col(task_col).alias("task"), F.col(answer_col).alias("answer"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                tasks, answers = b.column("task").to_pylist(), b.column("answer").to_pylist()
                of_answer, shared, of_task = containment(tasks, answers, words)
                defects: list[str | None] = []
                ends: list[str | None] = []
                for i, (task, answer) in enumerate(zip(tasks, answers)):
                    defect = end = None
                    task = task or ""
                    if answer is None or nothing_said(answer):
                        defect = "empty"
                    elif (of_task[i] == 0 or shared[i] >= COPIED * of_answer[i]) and copies(task, answer, of_answer[i], shared[i], of_task[i]):
                        defect = "copy"
                    elif refuses(task, answer):
                        defect = "refusal"
                    else:
                        here = language(answer)
                        if here and (there := language(task)) and here != there and here not in asked_languages(task):
                            defect = "language"
                        else:
                            off = breaks_off(answer)
                            if off:
                                defect = "truncated"
                            elif off is None:
                                end = ending(ITEM.sub("", last_line(answer)))
                    defects.append(defect)
                    ends.append(end)
                keep = pa.array([bool(d or e) for d, e in zip(defects, ends)])
                yield pa.record_batch([b.column("id"), pa.array(defects, pa.string()), pa.array(ends, pa.string())], names=["id", "defect", "pair"]).filter(keep)

    kind = rows.schema["id"].dataType.simpleString()
    seen = materialise(rows.mapInArrow(judge, f"id {kind}, defect string, pair string"), "judged")
    # the end of a last item is a break if its two words go on elsewhere but end no other item; words not met
    # together are judged by the last one, which hardly ever ends an item
    table = materialise(_item_table(records, answer_col), "items")
    two, one = (table.select(F.col("words").alias(c), F.col("ends").alias(f"{c}_ends"), F.col("inside").alias(f"{c}_inside")) for c in ("pair", "word"))
    open_ends = seen.filter("pair is not null").withColumn("word", F.element_at(F.split("pair", " "), -1)).join(two, "pair", "left").join(one, "word", "left").fillna(0)
    unmet = (F.col("pair_inside") == 0) & (20 * F.col("word_ends") <= F.col("word_ends") + F.col("word_inside"))
    cut = open_ends.filter((F.col("pair_ends") == 0) & ((F.col("pair_inside") > 0) | unmet)).select("id", F.lit("truncated").alias("defect"))
    return seen.filter("defect is not null").select("id", "defect").unionByName(cut)
