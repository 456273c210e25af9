"""Word lists. The large ones are parameters: ``load`` reads files of words; the small
built-in lists below are common English words and names, enough to run without files.

What lists of a few hundred words cannot hold, ``SURNAME_FORM`` tells by the endings and
beginnings that languages form family names with.
"""

from __future__ import annotations

from ..options import Lexicon

# Titles before a name, letters after it, words inside it: common ones of our own choice.
HONORIFICS = frozenset(
    "mr mrs ms miss mx master madam dr doctor prof professor sir dame lord lady rev reverend father fr sister brother rabbi imam pastor bishop "
    "capt captain lt lieutenant sgt sergeant maj major col colonel gen general adm admiral hon judge justice officer detective inspector senator".split()
)
NAME_SUFFIXES = frozenset("jr sr ii iii iv v phd md dds rn jd cpa esq mba msc".split())
PARTICLES = frozenset("von van der den de del della di da dos das du la le el al ibn bin ben abu ter ten zu zur af av".split())
#: Beginnings and endings that only family names have (Gaelic, Nordic, Slavic, Greek, Georgian, Romanian, Armenian, Spanish, German).
SURNAME_FORM = (
    r"(?:Mc|Mac|O['’])\p{Lu}\p{Ll}{2,}|\p{Lu}\p{Ll}+(?:sson|sdottir|owski|ewski|czyk|enko|ovich|ovic|escu|opoulos|akis|ashvili|adze|nyan|ández|ínez|íguez|bauer|huber)"
)
# Legal forms and words that firms' names end in; the forms with points follow from them by rule.
_FORMS = "Inc LLC LLP LP Ltd PLC Corp Co GmbH AG KG NV BV SA SAS SARL SRL SpA Oy AB ApS AS Pty".split()
_KINDS = (
    "Incorporated Limited Corporation Company Holdings Group Partners Associates Ventures Capital Labs Technologies Solutions Systems Industries "
    "Enterprises Foundation Trust Institute Society Association Consulting"
).split()
ORG_SUFFIXES = (*_KINDS, *_FORMS, *(f"{f}." for f in _FORMS), *("".join(f"{c}." for c in f) for f in _FORMS if f.isupper()))

_GIVEN = (
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony donald steven paul andrew "
    "joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin "
    "scott brandon benjamin samuel gregory frank raymond patrick alexander jack dennis jerry tyler aaron jose henry adam nathan peter "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley kimberly emily "
    "donna michelle dorothy carol amanda melissa deborah stephanie rebecca sharon laura cynthia kathleen amy angela shirley anna brenda "
    "pamela emma nicole helen samantha katherine christine rachel carolyn janet maria heather diane julie joyce victoria kelly sophie "
    "priya fatima ahmed mohammed wei chen yuki olga ivan elena luis carlos sofia pierre marie hans greta ingrid lars kofi amara aisha "
    "oliver liam noah ethan lucas mia olivia isabella hannah chloe zoe leah simon martin philip hugo felix oscar leon klaus jürgen claire "
    "camille antoine julien giulia marco luca paolo chiara ana joao pedro miguel diego javier lucia carmen rosa nadia omar youssef layla "
    "hassan dmitri natalia svetlana piotr agnieszka sanjay rahul anita deepa kenji hiroshi mei ling minh"
)
_SURNAMES = (
    "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson thomas taylor "
    "moore jackson martin lee perez thompson white harris sanchez clark ramirez lewis robinson walker young allen king wright scott "
    "torres nguyen hill flores green adams nelson baker hall rivera campbell mitchell carter roberts gomez phillips evans turner diaz "
    "parker cruz edwards collins reyes stewart morris morales murphy cook rogers gutierrez ortiz morgan cooper peterson bailey reed "
    "kelly howard ramos kim cox ward richardson watson brooks chavez wood bennett gray mendoza ruiz hughes price alvarez castillo "
    "patel singh khan ali ahmed okonkwo kowalski novak schmidt mueller fischer weber rossi ferrari silva santos dubois bernard "
    "hansen larsen olsen nielsen jensen andersen johansson karlsson lindberg virtanen kovacs horvat popov ivanov petrov sokolov "
    "müller schneider meyer wagner becker schulz hoffmann koch bauer richter wolf zimmermann lefebvre moreau laurent girard roux fournier "
    "romano colombo ricci marino greco bruno conti esposito fernandez moreno romero navarro torres vega costa oliveira pereira almeida "
    "tanaka suzuki sato watanabe yamamoto wang zhang liu yang huang zhao tran pham sharma gupta kumar mehta reddy hussain mahmoud haddad"
)
_STOPWORDS = (
    "the a an and or but if then else when while for to from of in on at by with without into over under after before between this that "
    "these those it its he she they we you i me my your our their his her them us is are was were be been being do does did have has had "
    "will would can could shall should may might must not no yes all any each every some many more most other new old first last next "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october "
    "november december will mark grant rose hope grace faith summer dawn chase frank rich drew bill art pat page street road avenue "
    "please thanks thank regards dear hello hi best sincerely note subject date time re fw email phone address customer client account "
    "service support team project report invoice order payment contract meeting company department office university hospital court "
    "quarterly annual monthly weekly draft final version section chapter table figure appendix total amount price"
)
DEFAULT = Lexicon(frozenset(_GIVEN.split()), frozenset(_SURNAMES.split()), frozenset(_STOPWORDS.split()))


def load(given: str | None = None, surnames: str | None = None, stopwords: str | None = None) -> Lexicon:
    """Lists from UTF-8 files of words divided by white space, read on the driver; None keeps the built-in list."""

    def words(path: str | None, default: frozenset[str]) -> frozenset[str]:
        if path is None:
            return default
        with open(path, encoding="utf-8") as f:
            return frozenset(f.read().lower().split())

    return Lexicon(words(given, DEFAULT.given), words(surnames, DEFAULT.surnames), words(stopwords, DEFAULT.stopwords))
