"""Refusals, composed of their parts: an automaton over the words of a sentence finds who speaks, what is negated and which act of
speech is declined, and a sentence refuses if these stand in an order that says so.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick

from poolaudit.llm.words import words

# Parts of a refusal by language, as words() gives them. A final * matches the beginning of a word.
#: Negated ability, will or leave of the speaker, present or future; where the negation stands on its own, the speaker.
NEGATED = {
    "en": "i can t|i cannot|i can not|i can neither|i won t|i will not|i ll not|i shall not|i should not|i shouldn t|i am not|i m not|i am unable|i m unable|unable to|not able to|i am in no position|i m in no position|i may not|i must not|i do not|i don t|i choose not|i d rather not|i would rather not|rather not|i prefer not|i d prefer not|i would prefer not|prefer not to|not be right for me|not be appropriate for me|not possible for me|impossible for me|do not allow me|don t allow me|does not allow me|doesn t allow me|do not permit me|does not permit me|prevent me from|prevents me from|told not to|instructed not to|asked not to|trained not to|programmed not to|not allowed to|not permitted to|we can t|we cannot|we are unable|we are not able|we do not|we don t|d rather leave|would rather leave|not my place",
    "de": "ich|mir|mich|wir",
    "es": "no puedo|no la puedo|no lo puedo|no le puedo|no te puedo|no se lo puedo|no podría|no podré|no voy a|no quiero|no debo|no deseo|no sabría|no estoy|no soy|prefiero no|preferiría no|no me corresponde|no me es posible|me es imposible|me resulta imposible|no me está permitido|no se me permite|no tengo permi*|no tengo autoriza*|no me siento|no podemos",
    "fr": "je ne|il ne m est pas|il ne m appartient|il m est impossible|il m est interdit|je suis dans l incapacité|je n ai pas le droit|je n ai pas l autorisation|je préfère ne|je préférerais ne|nous ne pouvons",
    "ru": "не могу|не смогу|не буду|не хочу|не стану|не готов*|мне нельзя|предпочитаю не|предпочту не|предпочёл бы не|предпочел бы не|предпочла бы не|не имею права|не в состоянии|мне не положено|не возьмусь|не берусь|не вправе|мне запрещено|мне не разреш*|невозможно мне|не можем",
    "it": "non posso|non potrei|non potrò|non voglio|non vorrei|non sono|preferisco non|preferirei non|non mi è possibile|non mi è consentito|mi è impossibile|non intendo|non desidero|non spetta a me|non riesco a|non mi sento|non ho il permesso|non possiamo",
    "pt": "não posso|não poderei|não vou|não quero|não consigo|prefiro não|preferiria não|não me é possível|é me impossível|não estou|não tenho permiss*|não tenho autoriza*|não desejo|não devo|não me sinto|não me cabe|não podemos",
    "nl": "ik|mij|wij",
    "sv": "jag|mig|vi",
}
#: Languages in which the negation stands on its own, and may precede or follow the act.
NEGATION = {
    "de": "nicht|nichts|kein|keine|keinen|keinerlei|außerstande|ungern|unmöglich|untersagt|verboten",
    "nl": "niet|niets|geen|onmogelijk|verboden",
    "sv": "inte|ingenting|ej|omöjligt|förbjudet",
}
#: Acts of speech and help that are declined.
ACTS = {
    "en": "help*|assist*|answer*|discuss*|provid*|compl*|do that|do this|shar*|comment*|respond*|repl*|talk*|speak*|say|tell|writ*|give|giv*|get into|make a|offer*|advis*|advice|describ*|explain*|summari*|go into|go further|address*|engag*|take part|take on|take this|fulfil*|continu*|produc*|generat*|support*|weigh in|recommend*|opin*|express*|it to|that to|this to|be of|leav*|speculat*|elaborat*|assess*|judg*|advic*",
    "de": "beantwort*|antwort*|weiterhelfen|helfen|sagen|äußern|sprechen|auskunft|kommentier*|mitteilen|eingehen|unterstützen|schreiben|diskutier*|erzählen|erklären|geben|beitragen|verraten|erlaubt|gestattet|angaben|auskünfte|äußere*|stellung|spreche|rede|reden|beurteil*|bewert*|bearbeit*",
    "es": "ayud*|respond*|habl*|contest*|opin*|coment*|discut*|decir*|escrib*|dar|ofrec*|compart*|trat*|explic*|asist*|proporcion*|pronunci*|hacerlo|complac*",
    "fr": "aid*|répond*|parl*|discut*|comment*|dire|fourni*|donn*|écri*|partag*|trait*|abord*|prononc*|exprim*|assist*|expliqu*|satisfai*|le faire",
    "ru": "ответ*|отвеч*|помо*|обсужд*|обсуд*|говор*|рассказ*|сказ*|коммент*|писа*|напис*|предостав*|дать|дава*|объясн*|высказ*|делит*|подел*|выполн*|касат*",
    "it": "rispond*|aiut*|parl*|discut*|comment*|dire|forni*|scriv*|condivid*|assist*|spieg*|esprim*|tratt*|dar*",
    "pt": "respond*|ajud*|fal*|discut*|coment*|dizer|fornec*|escrev*|compartilh*|partilh*|explic*|tratar|dar|auxili*|opin*",
    "nl": "help*|beantwoord*|antwoord*|besprek*|zeggen|praten|uitspra*|del*|schrijv*|uitlegg*|ingaan|geven|vertell*",
    "sv": "hjälp*|svara*|besvara*|diskuter*|säga|prata*|uttala*|skriv*|förklar*|ge|berätta*|kommenter*",
}
#: What declines by itself.
DECLINING = {
    "en": "not something i can|not something i am able|not something i m able|not something i will|i must decline|i decline|i have to decline|i will decline|i ll decline|i need to decline|i must refuse|i refuse|i have to refuse|no comment|stay silent|remain silent|keep silent|unanswered|not a topic i|not a subject i|not a matter i|not something that i|i d rather we|i would rather we|i have no personal|i have no preference*|i have to pass|i will have to pass|i ll have to pass|i ll pass on|i must pass|i must abstain|i will abstain|i m going to pass|against my guidelines|against my policy|against my rules|violates my guidelines|not comfortable with that|do not have views|don t have views|do not have opinions|don t have opinions|do not have an opinion|don t have an opinion|do not have a view|do not have personal|don t have personal|have no opinion|have no views|have no view",
    "de": "zurückweisen|kein kommentar|unbeantwortet|muss ich ablehnen|ich muss ablehnen|lehne ich ab|ich lehne*|muss ich passen|ich muss passen|ich verweiger*|verweigere ich|ich enthalte mich|muss ich leider ablehnen|habe keine meinung|keine meinung zu",
    "es": "sin comentarios|sin responder|debo rechazar|tengo que rechazar|rechazo|me niego|debo declinar|tengo que declinar|declino|me abstengo|no tengo opini*|no tengo una opinión",
    "fr": "sans commentaire|sans réponse|je dois refuser|je refuse*|je décline*|je dois décliner|je m abstien*|je ne répondrai|je n ai pas d avis|je n ai pas d opinion*",
    "ru": "без комментариев|без ответа|вынужден* отказ*|отказываюсь|я откажусь|должен отказ*|должна отказ*|воздерж*|не имею мнения|нет мнения",
    "it": "nessun commento|devo rifiutare|mi rifiuto|devo declinare|declino|mi astengo|sono costrett* a rifiutare|non ho opinioni|non ho un opinione",
    "pt": "sem comentários|devo recusar|tenho de recusar|tenho que recusar|recuso|preciso recusar|me abstenho|não tenho opini*",
    "nl": "geen commentaar|moet ik weigeren|ik weiger|ik moet weigeren|weiger ik|moet ik passen|ik onthoud|heb geen mening",
    "sv": "inga kommentarer|jag måste avböja|jag avböjer|jag vägrar|måste jag avböja",
}
#: A limit of what the speaker does, and what says that something lies beyond it.
BEYOND = "beyond|outside|exceeds|übersteigt|außerhalb|überschreitet|sprengt|fuera de|supera|excede|más allá de|rebasa|dépasse|hors de|en dehors de|sort de|au delà de|excède|выходит за|вне|за пределами|превышает|oltre|esula|al di fuori|além d*|fora d*|ultrapassa|buiten|utanför"
LIMITS = "my remit|my scope|my role|my competence|my area|what i can|what i will|what i am|what i m|what i do|my abilities|my guidelines|meine*|mein|was ich|mi función|mi papel|mi competencia|mi ámbito|mis competencias|mis funciones|lo que puedo|mi alcance|mon rôle|mon domaine|mes compétences|mon champ|mes fonctions|ce que je|рамки|моих|моей|моего|мои|моё|mio ruolo|mie competenze|mia competenza|ciò che posso|meu papel|minha função|minhas competências|meu âmbito|meu alcance|mijn|mitt|min roll"

# Fragments of the courtesies around a refusal, and words that are courtesies by themselves.
COURTEOUS = {
    "en": "thank you|thanks|you understand|your understanding|perhaps try|please try|try a different|try another|please ask|something else|anything else|someone else|somebody else|let me know|fair question|good question|great question|interesting question|i appreciate|you would like to hear|you d like to hear|you asked about|you want to know|i understand|i see that you|feel free to|i m sorry|i am sorry|my apologies|i apologi*|please consult|please contact|happy to help with|glad to help with|other question*|another question",
    "de": "bitte frag*|danke|vielen dank|tut mir leid|ich hoffe|verständnis|versuche es|versuchen sie|jemand ander*|gute frage|entschuldig*|frag* gern*|etwas anderes|andere* frage*|es tut mir|du fragst|sie fragen|bedaure",
    "es": "gracias|lo siento|espero que|pregunta* a|intenta*|prueba con|buena pregunta|disculp*|perdón|otra pregunta|otra cosa|otra persona|entiendo que|lamento|comprensión",
    "fr": "merci|désolé*|j espère|essayez|essaie|demandez|demande à|bonne question|compréhension|adressez|posez|une autre question|autre chose|quelqu un d autre|je comprends que|je regrette|pardon",
    "ru": "спасибо|извин*|прост*|попробуй*|спросите|спроси|надеюсь|хороший вопрос|обратитесь|понимани*|задайте|другой вопрос|кому нибудь|кого нибудь|сожалени*|понимаю",
    "it": "grazie|mi dispiace|spero che|prova*|chiedi*|buona domanda|scus*|comprensione|altra domanda|qualcun altro|capisco che",
    "pt": "obrigad*|sinto muito|lamento|espero que|tente|pergunte|boa pergunta|desculp*|compreensão|outra pergunta|entendo que|outra pessoa",
    "nl": "bedankt|dank je|dank u|het spijt me|sorry|ik hoop|probeer|vraag het|goede vraag|begrip|andere vraag|iemand anders",
    "sv": "tack|tyvärr|förlåt|jag hoppas|försök|fråga någon|bra fråga|förståelse|ledsen",
}
PLEASANTRIES = frozenset("hm hmm well ah oh ok okay um uh er nun tja ähm bueno pues eh bon euh ben alors ну эм хм так beh allora então nou sorry unfortunately apologies regretfully alas hello hi dear leider bedauerlicherweise lamentablemente desafortunadamente hola malheureusement hélas bonjour увы сожалению purtroppo infelizmente helaas tyvärr please bitte".split())
# Words after which a sentence may turn to an answer after all.
_TURN = re.compile(r"[;:—–]|\b(?:but|though|although|however|yet|so|aber|doch|jedoch|pero|aunque|así que|mais|cependant|donc|но|однако|хотя|ma|però|mas|porém|maar|echter|men|dock)\b", re.IGNORECASE)

FIRST_PERSON = {"i", "me", "my", "we", "us", "our"}

_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|\n+")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]")


_DECIDING = {"declining", "negated", "beyond"}


@cache
def _automaton(deciding: bool = False) -> ahocorasick.Automaton:
    """Every phrase with its tags (part, language); phrases begin at a word, and those without * end at one. deciding: only those
    without which no sentence refuses."""
    tags: dict[str, set[tuple[str, str]]] = {}

    def add(part: str, lang: str, phrases: str) -> None:
        for p in phrases.split("|"):
            inner = p.endswith("*")
            # A * within a phrase stands for any ending of that word, which two phrases parted there would express; such a phrase
            # is found by its first part.
            key = " " + p.split("* ")[0].rstrip("*") + ("" if inner or "* " in p else " ")
            tags.setdefault(key, set()).add((part, lang))

    for part, table in (("negated", NEGATED), ("negation", NEGATION), ("act", ACTS), ("declining", DECLINING), ("courteous", COURTEOUS)):
        for lang, phrases in table.items():
            add(part, lang, phrases)
    add("beyond", "", BEYOND)
    add("limit", "", LIMITS)
    out = ahocorasick.Automaton()
    for p, t in tags.items():
        if deciding and not _DECIDING & {part for part, _ in t}:
            continue
        out.add_word(p, (len(p), tuple(t)))
    out.make_automaton()
    return out


#: Words between the parts of one refusal.
REACH = 14


def _found(found: list[str]) -> dict[str, dict[str, list[int]]]:
    """Places (in words) of each part and language in a sentence."""
    line = " " + " ".join(found) + " "
    out: dict[str, dict[str, list[int]]] = {}
    for stop, (size, tags) in _automaton().iter(line):
        at = line.count(" ", 0, stop - size + 2) - 1
        for part, lang in tags:
            out.setdefault(part, {}).setdefault(lang, []).append(at)
    return out


def _near(first: list[int], then: list[int]) -> bool:
    return any(0 <= b - a <= REACH for a in first for b in then)


def _beside(a: list[int], b: list[int]) -> bool:
    return _near(a, b) or _near(b, a)


def refuses(found: list[str], parts: dict[str, dict[str, list[int]]] | None = None) -> bool:
    """Whether a sentence, given by its words, declines."""
    parts = _found(found) if parts is None else parts
    if "declining" in parts:
        return True
    for lang, at in parts.get("negated", {}).items():
        acts = parts.get("act", {}).get(lang, [])
        if lang == "en" and min(at) > 1 and not FIRST_PERSON & set(found):
            continue  # of someone else; at the beginning of a sentence the speaker may be left out
        if lang in NEGATION:
            nots = parts.get("negation", {}).get(lang, [])
            if any(_beside([n], at) and _beside([n], acts) for n in nots):
                return True
        elif _near([a + 1 for a in at], acts) or lang == "ru" and _near(acts, at):
            return True
    beyond, limits = parts.get("beyond", {}).get("", []), parts.get("limit", {}).get("", [])
    return _near(beyond, limits)


def is_refusal(text: str, tokens: list[str], known: set[str]) -> bool:
    """Declines, and gives no answer beyond that: one of its sentences refuses, and all others are courtesies or hold nothing but
    stopwords (known) and pleasantries. tokens: words(text). What is quoted refuses nothing."""
    if next(_automaton(deciding=True).iter(" " + " ".join(tokens) + " "), None) is None:
        return False
    refused = False
    for sentence in _SENTENCE.split(text):
        own = _QUOTED.sub(" ", sentence)
        if not words(own):
            if words(sentence):
                return False
            continue
        declined = False
        for clause in _clauses(own):
            found = words(clause)
            parts = _found(found)
            if refuses(found, parts):
                declined = True
            elif declined and "courteous" not in parts and sum(w not in known and w not in PLEASANTRIES for w in found) >= ANSWERS:
                return False  # declined first, answered then
        if not declined:
            found = words(own)
            parts = _found(found)
            # A refusal may stretch over a turn ("I can't, though I'd like to, help").
            declined = refuses(found, parts)
            if not declined and "courteous" not in parts and any(w not in known and w not in PLEASANTRIES for w in found):
                return False
        refused |= declined
    return refused


#: Content words of a clause after a refusing one that make it an answer.
ANSWERS = 2


def _clauses(sentence: str) -> list[str]:
    """A sentence parted where it may turn."""
    return [c for c in _TURN.split(sentence) if words(c)]
