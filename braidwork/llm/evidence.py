"""Evidence in a message that software, not a person, wrote it: shapes, and kinds of words that occur together.

A message shows evidence of a kind if it holds a phrase of it. No phrase is a
verdict; a template is judged by the kinds found together (``verdict``), by the
shape of what programs print, and by the absence of a person who tells of it.
"""

from __future__ import annotations

import re

import ahocorasick

# Phrases by kind, a line for each language or topic.
PHRASES = {
    # parts of a service that can fail, be missing or be refused
    "thing": """
page|pages|webpage|this site|the site|our site|website|web site|server|servers|database|service|the url|this url|requested url|address|resource|session|security token|form token|token|csrf|connection|gateway|host|domain|the request|your request|this request|requests|the form you|document|this topic|this thread|this board|this forum|this area|this content|this section|your network|your ip|ip address|your account|home page|homepage|link|index
seite|server|datenbank|verbindung|dienst|webseite|website|sitzung|anfrage|anforderung|adresse|inhalt|dieses thema|diesen beitrag|diesen bereich|dieser bereich|ihr konto|dokument|zugriff
page|serveur|base de données|service|site|session|connexion|requête|adresse|ressource|ce sujet|ce message|ce contenu|accès|votre compte
página|servidor|base de datos|servicio|sitio|sesión|conexión|solicitud|dirección|recurso|este hilo|este mensaje|este tema|este contenido|acceso|su cuenta|la base
pagina|servizio|sessione|connessione|banca dati|sito|risorsa|página solicitada|banco de dados|serviço|conexão|sessão|solicitação|verbinding|pagina|serwer|strona|strony|połączenie|sesja|usługa
страница|страницы|страницу|сервер|сервис|сессия|соединение|база данных|доступ|запрос|сайт""",
    # what is said of them
    "fault": """
not found|cannot be found|can't be found|could not be found|couldn't be found|could not find|couldn't find|no longer here|no longer exists|no longer available|does not exist|doesn't exist|do not exist|has moved|has been moved|was moved|been removed|has been deleted|cannot be displayed|can't be displayed|could not be displayed|cannot be shown|cannot be loaded|could not be loaded|couldn't be loaded|failed to load|can't be reached|cannot be reached|could not be reached|unreachable|is unavailable|temporarily unavailable|currently unavailable|not available at this time|not responding|took too long to respond|is overloaded|over capacity|down for maintenance|down for scheduled maintenance|under maintenance|undergoing maintenance|has expired|is expired|have expired|timed out|time-out|timeout|refused to connect|connection refused|was reset|has gone away|was lost|lost connection|could not connect|cannot connect|can't connect|failed to connect|unable to connect|went wrong|error occurred|error has occurred|an error|internal error|unexpected error|server error|error establishing|hit a snag|on our end|on our side|has been told|been notified|been informed|too many|too quickly|too often|rate limit|not be processed|could not process|cannot be processed|unable to process|could not complete|invalid|expired|is not available|old link|outdated link|broken link|expired link|is offline|are offline
nicht gefunden|existiert nicht|nicht mehr vorhanden|nicht verfügbar|nicht erreichbar|überlastet|abgelaufen|verloren|ein fehler|fehler aufgetreten|fehler ist aufgetreten|serverfehler|datenbankfehler|fehlgeschlagen|wegen wartung|wartungsarbeiten|ungültig|unterbrochen|zeitüberschreitung|unterstützt die nötigen|schiefgelaufen|schiefgegangen|konnte nicht
introuvable|n'existe pas|n'existe plus|indisponible|a expiré|expirée|surchargé|une erreur|erreur interne|erreur du serveur|erreur de base|en maintenance|maintenance en cours|ne répond pas|perdue|impossible de|a échoué|invalide|mal passé
no encontrada|no encontrado|no existe|se ha movido|no disponible|ha caducado|ha expirado|no responde|sobrecargado|un error|error interno|error del servidor|error de base|en mantenimiento|por mantenimiento|no se pudo|no se puede|se perdió|perdida|inválido|no válido|salido mal
non trovata|non esiste|non disponibile|scaduta|si è verificato un errore|errore del server|não encontrada|não existe|indisponível|expirou|ocorreu um erro|erro interno|niet gevonden|bestaat niet|niet beschikbaar|is verlopen|er is een fout|nie znaleziono|nie istnieje|niedostępna|wygasła|wystąpił błąd
не найдена|не найден|не существует|недоступен|недоступна|истекла|произошла ошибка|ошибка сервера|внутренняя ошибка|не отвечает""",
    # refusals; these need no thing
    "refused": """
access denied|permission denied|access is denied|access was denied|access has been denied|is denied from|is restricted|is forbidden|do not have permission|don't have permission|no permission to|not have the required permission|not authorized to|not authorised to|not allowed to view|has been blocked|have been blocked|you are blocked|been banned|has been suspended|must be logged in|must be signed in|need to be logged in|must log in|log in to continue|sign in to continue|log in or register|sign in or register|register to continue|login required|authentication required|access blocked|attention required|unusual traffic|verify you are|verify that you are|confirm you are|prove you are|are not a robot|complete the captcha|solve the captcha|complete the security check
zugriff verweigert|zugriff nicht erlaubt|keine berechtigung|nicht berechtigt|müssen sich anmelden|müssen angemeldet sein|bitte melden sie sich an|gesperrt
accès refusé|accès interdit|n'avez pas les droits|n'avez pas la permission|n'avez pas l'autorisation|n'êtes pas autorisé|devez être connecté|veuillez vous connecter|veuillez vous reconnecter|vous reconnecter
acceso denegado|acceso prohibido|no tiene permiso|no tiene permisos|no está autorizado|debe iniciar sesión|inicie sesión|vuelva a identificarse|vuelva a iniciar sesión
accesso negato|acesso negado|toegang geweigerd|odmowa dostępu|brak dostępu
доступ запрещен|доступ запрещён|доступ ограничен|войдите в систему""",
    # what a page may need
    "needs": """
javascript|java script|js|js and cookies|js & cookies|scripts|scripting|client-side scripts|cookie|cookies|captcha
skripte|skripten|scripte
les scripts|scripts|los scripts|las cookies
скрипты|куки""",
    # that it needs it
    "require": """
enable|re-enable|activate|turn on|switch on|allow|permit|requires|require|required|needs|relies on|depends on|does not work without|doesn't work without|will not work without|does not function without|cannot be shown without|cannot be used without|is disabled|are disabled|switched off|turned off|is blocked|are blocked|got blocked|may be blocked|were blocked|did not load|didn't load|not enabled|must be enabled|is off
aktivieren|schalten sie|erlauben sie|benötigt|benötigen|braucht|erfordert|deaktiviert|eingeschaltet
activer|autoriser|activez|autorisez|a besoin|nécessite|requiert|désactivé|désactivés
active|habilite|permita|necesita|requiere|desactivado|desactivados|activar
abilitare|attiva|ative|habilite|schakel|włącz
включите|разрешите""",
    # what programs ask of their users
    "ask": """
please|try again later|please try again|try again in|reload the page|refresh the page|reload this page|sign in again|log in again|go back to|return to|contact the administrator|contact the webmaster|contact support|contact the site|please wait|check the address|check the url|check your connection|make sure|you need to|you must
versuchen sie es|versuchen sie|bitte|laden sie|neu laden|wenden sie sich|kontaktieren sie
réessayez|veuillez|merci de|merci d'|rechargez|contactez
inténtelo|vuelva a|por favor|recargue|póngase en contacto|intente
riprova|tente novamente|probeer het|spróbuj ponownie|spróbuj
попробуйте|повторите|обновите""",
    # how software speaks to whom it serves
    "voice": """
you may have|you are sending|you were looking for|you are looking for|you requested|you have requested|your request|your browser|this browser|your session|your connection|your network|your account|your ip|our team|on our end|on our side|we could not|we couldn't|we were unable|we are unable|we hit|the form you|checking your|checking if|checking the|just a moment|loading comments|loading more|loading the|it looks like|this page|this site|this board|this thread|this topic|this app|this content|this area|this forum|the requested|requested page|the editor|before opening|before continuing|to continue|to view|to run this app|to read the rest|to see this|has been logged|oops|whoops|uh oh
ihr browser|ihre sitzung|ihre anfrage|ihr konto|angeforderte|angeforderten|ihre verbindung|um fortzufahren|anzuzeigen|anzeige dieser|zu sehen
votre navigateur|votre session|votre requête|du navigateur|demandée|votre compte|pour continuer|pour afficher|cette page
su navegador|su sesión|su solicitud|que busca|solicitada|su cuenta|para continuar|para ver|esta página|el servidor
il tuo browser|seu navegador|uw browser|twoja przeglądarka
ваш браузер|вашего браузера|запрошенная|запрашиваемая""",
    # waiting screens and ways out
    "check": """
return to the index|return to the home page|return to the homepage|go back to the home page|go back to the homepage|back to the front page|zurück zur startseite|retour à l'accueil|volver al inicio
checking your site|checking your browser|checking your connection|checking if the site|checking the site connection|verifying you are human|loading comments|just a moment|please wait while|redirecting you
browser wird geprüft|browser wird überprüft|browser wird gerade|ihr browser unterstützt
vérification du navigateur|vérification de votre navigateur|votre navigateur ne
comprobando su navegador|verificando su navegador|su navegador no
browser does not support|browser doesn't support|browser is not supported|browser is out of date
проверка браузера""",
    # a person who tells of it, by himself or in time
    "person": """
i|i'm|i've|i'd|i'll|me|my|mine|myself|we had|we were|we got|we had to|he|she|his|her|they|someone|somebody|everyone|anyone|people|yesterday|last week|last month|last night|last year|this morning|every|always|often|sometimes|usually|now and then|again and again|ago|used to|once|that was all|thanks|thank you|does anyone|has anyone|whenever|until|friendlier|imho|lol|btw|says|said|told|shows up|means|that way|could be|would be|instead of|too early|too late|turned out
ich|mir|mich|mein|meine|meinen|gestern|neulich|jedes|jeden|immer|manchmal|wir|letzte woche|danke|hat jemand|weiß jemand
je|j'ai|m'|moi|mon|ma|mes|hier soir|toujours|parfois|nous|chaque|quelqu'un|merci à
yo|mi|mis|me|ayer|siempre|a veces|nosotros|cada|alguien|gracias
io|mio|ieri|eu|meu|ontem|ik|mijn|gisteren|ja|moja|wczoraj
я|мне|мой|меня|вчера""",
}

_REASON = (
    r"(?:bad request|unauthori[sz]ed|payment required|forbidden|(?:page |file )?not found|method not allowed|not acceptable|request time-?out|conflict|gone|payload too large|too many requests|unavailable for legal reasons"
    r"|internal (?:server )?error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|web server is down|connection timed out)"
)
# Shapes of what servers and programs print.
_SHAPE = re.compile(
    "|".join(
        [
            r"^\W*(?:<[^>]+>\s*)*(?:http/[\d.]+ )?(?:error |fehler |erreur |código |status |ошибка )?[45]\d\d\b[\s:.,–-]*" + _REASON,
            r"<(?:title|h1)>[^<]*(?:\b[45]\d\d\b|" + _REASON + ")", r"<noscript>",
            r"[{]\W{0,2}(?:status|code|error)\W{1,4}[45]\d\d\b",
            r"(?:^|[.!…]\s+)(?:http )?(?:error|fehler|erreur|código de error|ошибка) [45]\d\d\s?[:.]", r"^\W*(?:error|fehler|erreur|ошибка) [45]\d\d\W*$",
            r"\b(?:fatal|parse) error: |\b(?:warning|notice|deprecated): (?:undefined|division by|uninitialized|trying to|array to|unknown)\b|\bin (?:/[\w.-]*)+ on line \S", r"\btraceback \(most recent call last\)|^\W*(?:uncaught |unhandled )\w*(?:error|exception)\b",
            r"^\W*(?:exception in thread|caused by: )|^\s*at [\w$.<>@]+\((?:[\w$.@]+\.(?:java|kt|scala|js):[\d#]+|native method|unknown source)\)|^\s*(?:[a-z]\w*\.){2,}[A-Z]\w*(?:Exception|Error)\b|^\s*file \"[^\"]*\", line [\d#]+, in |\bpanic: runtime error\b|\bsegmentation fault\b",
            r"\bsqlstate\b|\bora-[\d#]+|\b(?-i:ERR_[A-Z_]+)\b|^\W*(?-i:[A-Z]\w+(?:Error|Exception)): |\bsyntax error (?:at or )?near\b|\bstack trace:", r"\bnginx/[\d#.]+$|\bapache/[\d#.]+ .*\bserver at\b",
        ]
    ),
    re.I,
)
# A shape holds one of these, in small letters, or a status number.
_MARKS = "error|exception|<|{|traceback| on line |sqlstate|caused by: |\", line |panic: |segmentation fault|stack trace|nginx/|apache/|ora-|warning: |notice: |deprecated: |err_|.java:|.kt:|.scala:|.js:|(native method)|(unknown source)".split("|")
_STATUS = [str(n) for n in range(400, 600)]

_ADDRESS = re.compile(r"(?:^|\s)@(?=\s)")  # the mark of a masked address

KINDS = tuple(PHRASES)
_PERSON = KINDS.index("person")
_WEAK = {KINDS.index(k) for k in ("thing", "ask", "require", "voice", "person")}


def _automaton() -> ahocorasick.Automaton:
    kinds: dict[str, set[int]] = {}
    for n, text in enumerate(PHRASES.values()):
        for phrase in text.replace("\n", "|").split("|"):
            if phrase.strip():
                kinds.setdefault(phrase.strip(), set()).add(n)
    a = ahocorasick.Automaton()
    for mark in (*_MARKS, *_STATUS):
        a.add_word(mark, (len(mark), 0, False, mark in _MARKS, True))
    for phrase, n in kinds.items():
        a.add_word(phrase, (len(phrase), sum(1 << k for k in n), any(k not in _WEAK for k in n), phrase in _MARKS, phrase in _MARKS))
    a.make_automaton()
    return a


_FIND = _automaton()


def plain(text: str) -> str:
    return text.lower().replace("’", "'")


def _apart(low: str, end: int, n: int) -> bool:
    """Whether what ends there is no part of a longer word or number."""
    return not (low[end + 1 : end + 2].isalnum() or end >= n and low[end - n].isalnum())


def promising(low: str) -> bool:
    """Whether a text, in small letters, holds any phrase or mark without which nothing in it is a case; a quick test."""
    for end, (n, _, strong, anywhere, mark) in _FIND.iter(low):
        if anywhere or (strong or mark) and _apart(low, end, n):
            return True
    return False


def kinds_in(message: str) -> int:
    """The kinds of evidence in a message, as bits; the bit after the last kind is a shape."""
    low = plain(message)
    bits = 1 << KINDS.index("thing") if _ADDRESS.search(message) else 0
    marked = False
    for end, (n, kinds, _, anywhere, mark) in _FIND.iter(low):
        if _apart(low, end, n):
            bits |= kinds
            marked |= mark
        marked |= anywhere
    if marked and _SHAPE.search(message):
        bits |= 1 << len(KINDS)
    return bits


def verdict(bits: int) -> bool:
    """Whether a template with this evidence is a case."""
    has = lambda k: bool(bits >> KINDS.index(k) & 1)
    if bits >> len(KINDS) & 1:
        return True
    if bits >> _PERSON & 1:
        return False
    if has("check") or has("refused"):
        return True
    if has("fault"):
        return has("thing") or has("voice") or has("ask")
    if has("needs"):
        return has("require") and (has("voice") or has("ask") or has("thing"))
    return False
