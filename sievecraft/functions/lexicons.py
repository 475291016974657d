"""Data of the detectors: patterns of personal data, toxic words, language profiles, language names, prices."""

from __future__ import annotations

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"


def _alone(core: str) -> str:
    """core with no digit on either side."""
    return rf"(?<!\d){core}(?!\d)"


#: Cores of the patterns in the order they apply; all but e-mail stand between non-digits. Patterns, keywords and profiles are
#: data, taken over as they are so that results are equal.
PII_CORES = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone_us": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "credit_card": r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}",
    "ip_address": rf"{_OCTET}(?:\.{_OCTET}){{3}}",
}
PII = {k: ("(?U)" + (core if k == "email" else _alone(core))) for k, core in PII_CORES.items()}
REDACTED = "[REDACTED]"

#: Default keywords, in alphabetical order.
TOXIC = (
    "asshole bastard bitch chink crap damn dick faggot fuck kike".split()
    + ["kill yourself"]
    + "kys nigger piss retard shit slut spic whore".split()
)

# One string per language, entries parted by "|" in alphabetical order; "_" stands for a space. Entries that aren't
# three characters long never match, but count in the divisor, and so does each repeated entry.
_PROFILES = {
    "en": "_an|_be|_co|_in|_is|_of|_re|_th|_to|an_|and|at_|ed_|ent|er_|es_|he_|in_|ing|ion|is_|nd_|ng_|of_|on_|or_|re_|the|tion|to_",
    "es": "_co|_de|_el|_en|_la|_lo|_qu|_se|_un|aci|al_|as_|ció|de_|do_|el_|en_|ent|er_|es_|ión|la_|los|on_|os_|que|re_|se_|ue_|ón_",
    "fr": "_co|_de|_de|_en|_et|_la|_le|_le|_pa|_qu|_un|de_|en_|ent|es_|et_|ion|la_|le_|les|men|ne_|ns_|nt_|on_|ons|que|re_|tion|ue_",
    "de": "_au|_be|_da|_de|_de|_di|_ei|_un|ber|ch_|che|den|der|die|ein|eit|en_|er_|gen|ich|ie_|ier|in_|ine|nd_|sch|te_|und|ung|ver",
    "pt": "_co|_da|_de|_do|_em|_no|_os|_pa|_qu|_se|_um|ade|al_|as_|com|da_|de_|do_|em_|ent|er_|es_|men|nte|os_|que|to_|ue_|ão_|ção",
    "it": "_ch|_co|_de|_di|_il|_in|_la|_pe|_un|ato|che|con|del|di_|ell|ent|il_|in_|ion|la_|le_|lla|ne_|one|per|re_|ta_|to_|tti|zione",
    "ru": "_в_|_вс|_и_|_ко|_на|_не|_об|_по|_пр|_со|ать|ени|ест|на_|ние|ных|ого|ста|то_|ть_",
    "zh": "",
    "ja": "",
    "ko": "",
}
PROFILES = {k: [x.replace("_", " ") for x in v.split("|") if x] for k, v in _PROFILES.items()}
#: Divisors; the three scripts without an entry of three characters keep theirs, of 30.
PROFILE_SIZES = {k: len(v) or 30 for k, v in PROFILES.items()}

LANGUAGES = dict(
    x.split("=")
    for x in (
        "ar=Arabic de=German en=English es=Spanish fr=French hi=Hindi it=Italian ja=Japanese ko=Korean nl=Dutch pl=Polish"
        " pt=Portuguese ru=Russian sv=Swedish th=Thai tr=Turkish vi=Vietnamese zh=Chinese"
    ).split()
)
