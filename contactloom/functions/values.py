"""Fixed values that decide results: providers, endings, words of roles and bounces."""

# Providers that ignore a +tag, and those that also ignore dots.
PLUS_TAG = ["gmail.com", "googlemail.com", "yandex.ru", "yandex.com", "yandex.ua", "yandex.by", "yandex.kz", "yandex.com.tr", "ya.ru", "outlook.com", "hotmail.com", "live.com"]
IGNORE_DOTS = ["gmail.com", "googlemail.com", "yandex.ru", "yandex.com", "yandex.ua", "yandex.by", "yandex.kz", "yandex.com.tr", "ya.ru"]
GMAIL = ["gmail.com", "googlemail.com"]
# Providers of personal mail that are neither local nor foreign companies.
GLOBAL_MAIL = [
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "icloud.com", "proton.me", "protonmail.com", "mail.com",
    "gmx.com", "aol.com", "msn.com", "pm.me", "yandex.com", "yandex.ru", "ya.ru", "mail.ru", "bk.ru", "list.ru", "inbox.ru", "rambler.ru", "lenta.ru",
]
RU_LIKE = ["ru", "рф", "su"]
LOCAL_ENDINGS = [".ru", ".рф", ".su"]
LOCAL_EXTRA = ["gmail.com"]
DOMAIN_TYPOS = {"gmail.ru": "gmail.com", "gnail.com": "gmail.com", "gmal.com": "gmail.com", "eandex.ru": "yandex.ru", "yadnex.ru": "yandex.ru"}
OCR_TLDS = ["ru", "com", "org", "net", "edu", "ac", "io", "uz", "su", "by", "kz"]
KNOWN_TLDS = (
    "com org net edu gov mil int info biz name pro aero coop museum travel mobi online site agency app dev io ai club xyz top store tech "
    "ru su by kz ua uz kg am az ge xn--p1ai xn--80asehdb us uk ca de fr it pl cz sk ch se no fi es pt nl be tr cn jp kr lt lv ee in br ar au nz at "
    "dk gr hu ro rs bg md il ie hk sg my id th vn pk ae qa sa eg ma tn al mk ba hr si me is li za ng ke"
).split()
# Words of a local part or domain that mark a shared mailbox.
ROLE_WORDS = (
    "info kontakt contact service support help sales office press pressa editor editors editorial journals journal admissions career hr department dean "
    "reception priem otdel kafedra dekanat spravka redak rekto uchsec magistr bakalavr aspirant nauka kantsel public ojs mailer mail postmaster webmaster"
).split()
# Parts of a local part that mark one, where no letter or digit stands before and no letter after.
ROLE_FRAGMENTS = (
    "admin marketing media jobs recruit hello hi team newsletter services editor editorial press career hr postmaster noreply no-reply donotreply "
    "do-not-reply service support sales kafedra кафедра dekanat деканат priem прием priemnaya приемная redakciya редакция otdel отдел buh бухг kadr кадр "
    "ucheb учебн biblioteka библиотека magistratura магистратура aspirantura аспирантура kanc канцеляр iis it-otdel it lab лаборатория dep department "
    "faculty fac fakultet факультет kurs курс metod метод"
).split()
# Whole local parts of roles, contexts of authors and of departments, and the shape of a person's name.
ROLE_LOCAL = "no[-_.]?reply|do[-_.]?not[-_.]?reply|postmaster|webmaster|mailer(?:[-_.]?daemon)?|mailbot|bounce"
AUTHOR_CONTEXT = "author|corresponding\\s+author|автор|корресп(?:онденц)?и?рующ"
ROLE_CONTEXT = "кафедр|редакц|при[её]мн|отдел|служб|департамент|department|office|support|centre|center|комитет|институт|faculty|факультет|press"
NAME_SHAPE = "^[a-zа-яё]+(?:[._-][a-zа-яё]+){0,2}(?:[._-][a-zа-яё]{1,3})?$"
HARD_PHRASES = ["user not found", "invalid mailbox", "no such user", "unknown user", "non-local recipient verification failed", "recipient address rejected", "user is terminated", "mailbox unavailable", "mailbox disabled"]
SOFT_PHRASES = ["temporary", "try again later", "greylist", "graylist", "timed out", "timeout", "rate limit", "too many connections", "temporarily deferred", "temporarily unavailable"]
OUTCOMES = ["sent", "blocked", "cooldown", "undeliverable", "error", "unchanged"]
SUCCESS = ["sent", "success", "ok"]
