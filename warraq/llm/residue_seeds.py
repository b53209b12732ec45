"""Seed texts of the residue models, put together by rule from parts of public, general wordings.

Notices: what is wrong with which thing, what to do about it, what scripts are needed for, in four languages and the
dialect, and the published phrases of HTTP statuses and operating-system errors.  Filler: the classical passages that dummy
text is cut from, and words that stand for nothing.  Prose: frames in which people speak of such things.  Nothing here is
taken from the tables that the operator is run on.
"""

from __future__ import annotations

import errno
import http
import os
import random

# (things, what is wrong with them, what to do, needs of scripts), by language.
_EN_THINGS = ["the page", "this page", "the site", "the server", "the file", "the document", "the resource", "the link", "this topic", "the thread", "the forum", "this post", "your session", "the request", "the connection", "the database", "the service", "the address", "the content", "your request", "the host", "the application"]
_EN_WRONG = [
    "could not be found", "was not found", "does not exist", "no longer exists", "has been moved", "has been deleted", "was removed", "is temporarily unavailable", "is not available", "is down for maintenance", "has expired",
    "timed out", "could not be reached", "is not responding", "did not respond in time", "was refused", "was denied", "failed", "is not valid", "is restricted", "is forbidden", "could not be loaded", "could not be displayed", "cannot be opened",
    "is overloaded", "was interrupted", "returned an unexpected error", "was closed unexpectedly",
]
_EN_DO = [
    "please try again later", "please try again in a few minutes", "go back to the home page", "return to the homepage", "back to home", "contact the administrator", "contact support with this reference number", "reload the page", "refresh and try again",
    "check the address", "check your network settings", "please sign in again", "log in to continue", "you must be logged in", "we apologise for the inconvenience", "sorry", "oops", "an error occurred", "something went wrong", "an unexpected error has occurred",
    "error code", "access denied", "you do not have permission", "you are not authorised", "you may not view or read this", "too many attempts, wait", "confirm that you are human", "security verification in progress", "unhandled exception", "fatal error on line",
    "warning: call to undefined function", "failed to connect to database", "syntax error near", "undefined variable", "undefined index", "stack trace", "out of memory", "internal error", "invalid token", "null reference exception", "segmentation fault", "module not found",
    "failed to open stream: no such file", "query failed", "invalid request", "report this problem", "incident number", "the requested operation was aborted",
]
_EN_SCRIPTS = [f"{a} {b}{c}" for a in ("please enable", "turn on", "you have to allow", "switch on", "activate") for b in ("JavaScript", "scripts", "cookies and scripts", "JS") for c in (" in your browser", " to continue", " to view this page", " to use this site", " and reload")] + [
    f"{a} {b} {c}" for a in ("this page", "this site", "this app", "the forum", "this content") for b in ("requires", "needs", "relies on", "cannot work without", "does not load without") for c in ("JavaScript", "scripts", "cookies")
] + [f"your browser {a} {b}" for a in ("does not support", "has disabled", "blocks", "is not running", "refuses") for b in ("JavaScript", "scripts", "cookies")] + ["<noscript>scripts are off</noscript>", "scripting is disabled", "verifying your browser before you continue", "unsupported browser, please upgrade"]

_FR_THINGS = ["la page", "cette page", "le site", "le serveur", "le fichier", "le document", "la ressource", "le lien", "ce sujet", "la discussion", "le forum", "ce message", "votre session", "la requête", "la connexion", "la base de données", "le service", "l'adresse", "le contenu", "votre demande", "l'application"]
_FR_WRONG = [
    "est introuvable", "n'a pas été trouvé", "n'existe pas", "n'existe plus", "a été déplacé", "a été supprimé", "a été retirée", "est temporairement indisponible", "n'est pas disponible", "est en maintenance", "a expiré", "ne répond pas", "n'a pas répondu à temps",
    "a été refusé", "a échoué", "n'est pas valide", "est réservé aux membres", "est interdit", "n'a pas pu être chargé", "ne peut pas être affiché", "ne peut être ouvert", "est saturé", "a été interrompu", "est inaccessible", "a rencontré un problème",
]
_FR_DO = [
    "veuillez réessayer plus tard", "merci de réessayer dans quelques instants", "retour à l'accueil", "revenir à la page d'accueil", "contactez l'administrateur", "signalez ce numéro d'incident", "rechargez la page", "actualisez la page", "vérifiez l'adresse",
    "vérifiez votre réseau", "veuillez vous reconnecter", "connectez-vous pour continuer", "veuillez nous excuser pour la gêne", "désolé", "oups", "une erreur est survenue", "une erreur inattendue s'est produite", "erreur interne", "code d'erreur", "accès refusé", "accès interdit",
    "vous n'avez pas la permission", "vous n'avez pas les droits nécessaires", "vous n'êtes pas autorisé", "trop de tentatives", "délai dépassé", "erreur fatale", "échec de la connexion", "numéro de référence", "vérification de sécurité en cours", "confirmez que vous n'êtes pas un robot",
]
_FR_SCRIPTS = [f"{a} {b}{c}" for a in ("veuillez activer", "activez", "vous devez autoriser", "merci d'activer") for b in ("JavaScript", "les scripts", "les cookies et les scripts") for c in (" dans votre navigateur", " pour continuer", " pour afficher cette page", " puis rechargez")] + [
    f"{a} {b} {c}" for a in ("cette page", "ce site", "ce forum", "ce contenu") for b in ("nécessite", "requiert", "a besoin de", "ne fonctionne pas sans", "ne s'affiche pas sans") for c in ("JavaScript", "scripts", "cookies")
] + [f"votre navigateur {a} {b}" for a in ("ne prend pas en charge", "a désactivé", "bloque", "n'accepte pas") for b in ("JavaScript", "les scripts", "les cookies")] + ["contrôle de votre navigateur en cours", "JavaScript est désactivé", "navigateur obsolète, mettez-le à jour"]

_AR_THINGS = ["الصفحة", "هذه الصفحة", "الموقع", "الخادم", "الملف", "الرابط", "هذا الموضوع", "المنتدى", "هذه المشاركة", "الجلسة", "الطلب", "الاتصال", "قاعدة البيانات", "الخدمة", "العنوان", "المحتوى", "المورد", "التطبيق"]
_AR_WRONG = [
    "غير موجودة", "غير موجود", "لم يتم العثور عليها", "لم نعثر عليه", "تم حذفه", "تم نقله", "محذوف أو منقول", "غير متوفرة حاليا", "غير متاح مؤقتا", "قيد الصيانة", "انتهت صلاحيته", "انتهت مهلته", "لا يستجيب", "تم رفضه", "مرفوض", "فشل",
    "غير صالح", "مخصص للأعضاء فقط", "ممنوع", "لا يمكن عرضها", "لا يمكن تحميله", "لا يمكن فتحه", "تعذر الوصول إليه", "متوقف عن العمل", "انقطع",
]
_AR_DO = [
    "يرجى المحاولة لاحقا", "الرجاء إعادة المحاولة بعد دقائق", "حاول مرة أخرى", "العودة إلى الصفحة الرئيسية", "ارجع إلى الرئيسية", "اتصل بمدير الموقع", "راسل الإدارة", "رقم البلاغ", "أعد تحميل الصفحة", "تأكد من العنوان", "الرجاء تسجيل الدخول", "سجل الدخول من جديد",
    "نعتذر عن الإزعاج", "عذرا", "عفوا", "تنبيه", "حدث خطأ", "حدث خطأ غير متوقع", "خطأ داخلي", "رمز الخطأ", "خطأ فادح", "ليس لديك صلاحية", "غير مصرح لك بالدخول", "تم رفض الوصول", "محاولات كثيرة جدا", "طلبات كثيرة", "جاري التحقق من الأمان", "أثبت أنك لست روبوتا", "تعطل داخلي",
]
_AR_SCRIPTS = [f"{a} {b}{c}" for a in ("يرجى تفعيل", "فعل", "الرجاء تشغيل", "عليك السماح ب") for b in ("جافاسكريبت", "JavaScript", "السكريبت", "الكوكيز والسكريبت") for c in (" في متصفحك", " للمتابعة", " لعرض الصفحة", " ثم أعد التحميل")] + [
    f"{a} {b} {c}" for a in ("هذه الصفحة", "هذا الموقع", "هذا المنتدى", "المحتوى") for b in ("يتطلب", "تحتاج إلى", "لا يعمل بدون", "لا تظهر بدون") for c in ("جافاسكريبت", "السكريبت", "الكوكيز")
] + [f"متصفحك {a} {b}" for a in ("لا يدعم", "يمنع", "أوقف") for b in ("جافاسكريبت", "السكريبت", "الكوكيز")] + ["جاري فحص المتصفح", "المتصفح قديم، قم بتحديثه"]

_DZ_THINGS = ["la page", "had la page", "le site", "had site", "le serveur", "le sujet", "lien", "la base", "session", "الصفحة هاذي", "السيت", "السيرفر", "الموضوع"]
_DZ_WRONG = ["makach", "ma kayench", "ma tekhdemch", "ma yekhdemch", "ma yredch", "tayeh", "rah habes", "tna7a", "tbedlet blastou", "maghlo9", "mamnou3", "ma yethalch", "ma theblatch", "ماكاش", "ما يخدمش", "طايح", "راه حابس", "تنحا", "مغلوق", "ما يتحلش"]
_DZ_DO = ["jareb men be3d", "3awed mbe3d", "weli l la page d'accueil", "rje3 l l'accueil", "ma 3andekch le droit", "sma7 lina", "kayen mochkil", "erreur", "connecti men jdid", "عاود من بعد", "ولي للرئيسية", "ما عندكش الحق", "اسمحلنا", "كاين مشكل"]
_DZ_SCRIPTS = [f"{a} {b} {c}" for a in ("active", "cha3el", "lazem tactivi", "khas tkhedem") for b in ("JavaScript", "les scripts", "les cookies") for c in ("f navigateur", "bach tchouf la page", "bach tkemel")] + ["navigateur ta3ek ma yekhdemch b les scripts", "rana nchoufou navigateur ta3ek", "شعل السكريبت باش تشوف الصفحة", "المتصفح تاعك ما يخدمش بالسكريبت"]


def _join(things: list[str], wrong: list[str], do: list[str]) -> list[str]:
    said = [f"{a} {b}" for a in things for b in wrong]
    # Every remedy is seen as often as a fault of one thing, before and after it.
    return said + [x for k, d in enumerate(do) for x in (f"{d}: {said[(7 * k + 3 * j) % len(said)]}" if j % 2 else f"{said[(7 * k + 3 * j) % len(said)]}, {d}" for j in range(12))]


def notices() -> list[str]:
    """All notice seeds."""
    status = [f"{a}{s.value} {s.phrase}" for s in http.HTTPStatus if s.value >= 400 for a in ("", "error ", "http ", "erreur ", "خطأ ")] + [s.description for s in http.HTTPStatus if s.value >= 400 and s.description]
    system = [f"{name}: {os.strerror(no)}" for no, name in sorted(errno.errorcode.items())]
    code = [f"ERR_{a}_{b}" for a in ("NETWORK", "SSL", "NAME", "CERT", "PROXY", "SOCKET", "ADDRESS") for b in ("FAILED", "TIMED_OUT", "NOT_RESOLVED", "UNREACHABLE", "INVALID", "RESET")]
    out = _join(_EN_THINGS, _EN_WRONG, _EN_DO) + _join(_FR_THINGS, _FR_WRONG, _FR_DO) + _join(_AR_THINGS, _AR_WRONG, _AR_DO) + _join(_DZ_THINGS, _DZ_WRONG, _DZ_DO)
    return [*out, *(4 * (_EN_SCRIPTS + _FR_SCRIPTS + _AR_SCRIPTS + _DZ_SCRIPTS)), *(2 * status), *system, *code]


# The passages of De finibus (book 1) in their usual corrupt form, which dummy text is cut from.
_CLASSIC = """Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo
consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum. Nemo enim ipsam
quia voluptas aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione sequi nesciunt. Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi
tempora incidunt ut labore et dolore magnam aliquam quaerat. Quis autem vel eum iure reprehenderit qui in ea velit esse quam nihil molestiae consequatur, vel illum qui dolorem eum fugiat quo nulla. Temporibus autem quibusdam et aut officiis
debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae. Itaque earum rerum hic tenetur a sapiente delectus, ut aut reiciendis voluptatibus maiores alias perferendis doloribus asperiores
repellat. Donec vitae justo risus, tempus arcu quam porta leo felis orci nibh, mauris tellus ornare semper lectus, fringilla congue sodales, maecenas suspendisse tincidunt ullamcorper scelerisque ultricies, curabitur dapibus laoreet."""
_CLASSIC_WORDS = [w.strip(".,").lower() for w in _CLASSIC.split()]
_STAND_INS = """
sample text goes here, dummy text, placeholder text, your title here, your content here, insert text here, add your description here
replace this text, text to be replaced, filler text, example text only, to be completed
texte d'exemple, texte de remplissage, texte à remplacer, votre titre ici, contenu à compléter, faux texte, insérez un texte
نص تجريبي، هذا النص للتجربة فقط، نص يستبدل لاحقا، ضع النص هنا، نص شكلي لملء المساحة، عنوان تجريبي
foo bar baz qux quux corge grault
""".strip().splitlines()


def filler_seed(words: int = 3000, seed: int = 5) -> str:
    """Dummy text by rule: words of the classical passages in any order, some with ends exchanged as generators of dummy text do."""
    r = random.Random(seed)
    out = []
    for _ in range(words):
        w = r.choice(_CLASSIC_WORDS)
        if r.random() < 0.25:
            other = r.choice(_CLASSIC_WORDS)
            w = w[: max(2, len(w) // 2)] + other[len(other) // 2 :]
        out.append(w)
        if r.random() < 0.03:
            out[-1] += "."
    return " ".join(out)


def fillers() -> list[str]:
    """All filler seeds."""
    return [*(6 * [_CLASSIC]), filler_seed(), *(8 * _STAND_INS)]


_SPEAK = {
    ("I got", "I keep getting", "he saw", "my friend has", "does anyone else have", "why is there", "we had", "she asked me about", "how do I fix"): ("an error on that page", "a 404 on their site", "the server down all night", "a database problem at work", "my session closed", "javascript turned off", "cookies in the browser", "dummy text on the poster"),
    ("j'ai eu", "mon ami a vu", "quelqu'un sait pourquoi", "ça fait deux jours que j'ai", "on m'a dit que", "je ne comprends pas", "il m'a montré", "comment je règle"): ("une erreur sur leur site", "le serveur en panne", "la page qui charge mal", "la connexion coupée", "les cookies bloqués", "du faux texte sur l'affiche", "javascript dans les réglages"),
    ("خرجت لي", "صديقي عنده", "من يعرف لماذا", "منذ يومين عندي", "قال لي أخي", "كيف أصلح", "لم أفهم"): ("مشكلة في الموقع", "صفحة لا تفتح في الهاتف", "خطأ في الخادم بالعمل", "تفعيل السكريبت من الإعدادات", "انقطاع الاتصال في البيت"),
    ("rani nchouf", "sahbi 3andou", "wach rak dir m3a", "gali khouya", "men lbare7 w ana 3andi", "كيفاش ندير مع", "راني نشوف", "قالولي على"): ("erreur f le site", "serveur tayeh f lkhedma", "javascript f les paramètres", "la page li ma thalch", "خطأ في السيت", "السيرفر لي طاح البارح"),
}


# Everyday sentences, (who, did what, to what, when), by language.
_EVERYDAY = (
    (("my brother", "my son", "our neighbours", "my grandmother", "he", "she", "we", "they all", "the teacher"), ("told me about", "forgot", "bought", "fixed", "has turned off", "showed us", "was looking for", "played with", "was happy with", "never understood"), ("the phone", "the tablet", "the old car", "the video", "a good book", "the children", "this site", "the settings"), ("since yesterday", "last night", "this morning", "all weekend", "without any problem", "and we laughed a lot", "but nothing works any more", "does anyone have an idea")),
    (("mon frère", "mon fils", "les voisins", "ma grand-mère", "il", "elle", "on", "nous", "le professeur"), ("m'a parlé de", "a oublié", "a acheté", "a réparé", "a coupé", "nous a montré", "cherchait", "jouait avec", "était content de", "n'a jamais compris"), ("le téléphone", "la tablette", "la voiture", "la vidéo", "un bon livre", "les enfants", "ce site", "les réglages"), ("depuis hier", "hier soir", "ce matin", "tout le week-end", "sans problème", "et on a bien ri", "mais maintenant plus rien ne marche", "vous avez une idée")),
    (("أخي", "ابني", "جيراننا", "جدتي", "هو", "هي", "نحن", "صديقي", "الأستاذ"), ("حدثني عن", "نسي", "اشترى", "أصلح", "أعجبه", "أرانا", "كان يبحث عن", "لعب مع", "لم يفهم"), ("الهاتف", "السيارة", "كتاب جميل", "الأولاد", "المدينة القديمة", "الفيديو", "هذا الموقع"), ("منذ أمس", "البارحة", "هذا الصباح", "والحمد لله", "وضحكنا كثيرا", "هل عندكم فكرة", "بلا مشكلة")),
    (("khouya", "sahbi", "jirana", "mama", "houwa", "hiya", "7na", "khti", "خويا", "صاحبي", "الجيران", "يما"), ("galli 3la", "nsa", "chra", "sla7", "warana", "kan y7awess 3la", "l3eb m3a", "ma fhemch", "قالي على", "نسا", "شرا", "كان يحوس على"), ("telephone", "tonobil", "la vidéo", "ktab mli7", "drari", "had le site", "التليفون", "الطونوبيل", "الفيديو", "الدراري"), ("men lbare7", "lbare7 fellil", "had sbah", "hamdoulah", "w d7ekna bezzaf", "kima kol mara", "من البارح", "الحمد لله", "وضحكنا بزاف", "كيما كل مرة")),
)


def spoken() -> list[str]:
    """Sentences in which people speak of errors, scripts and dummy text, and of everyday things."""
    about = [f"{a} {b}" for frames, things in _SPEAK.items() for a in frames for b in things]
    plain = [f"{a} {b} {things[(i + j) % len(things)]} {whens[(i * 3 + j) % len(whens)]}" for who, did, things, whens in _EVERYDAY for i, a in enumerate(who) for j, b in enumerate(did)]
    return about + plain


# Rows of common keyboards, for runs of neighbouring keys.
KEYBOARDS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "azertyuiop", "qsdfghjklm", "wxcvbn", "ضصثقفغعهخحجد", "شسيبلاتنمكط", "ئءؤرلاىةوزظ")
