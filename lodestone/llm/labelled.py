"""The labelled table from which the mention model is trained: sentences with the mentions marked as [kind|text].

A small grammar of everyday letters, forms, chats and notices in four languages is filled by rule: most names are put together from
syllables, so that the model learns how a mention is built and what stands around it, and not a list of words. Nothing here is taken
from the tables of a test: no sentence and no person's name of theirs stands in it (tests/llm/test_pii.py looks for them).
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")

#: Well-known given and family names; most persons of the table have names made from syllables instead.
GIVEN = "Michael Jennifer Christopher Jessica Matthew Ashley Joshua Amanda Andrew Nicole Anthony Stephanie Brian Melissa Kevin Rebecca Timothy Laura Jeffrey Sharon Gary Cynthia Edward Kathleen George Angela Kenneth Deborah Steven Barbara Charles Patricia Joseph Linda Richard Susan William Elizabeth Robert Mary James Emma Liam Noah Sophia Isabella Ethan Mia Lucas Harper Benjamin Evelyn Hans Günter Monika Ursula Dieter Gisela Uwe Brigitte Stefan Petra Wolfgang Renate Pierre Nathalie Jacques Sylvie François Isabelle Thierry Véronique Guillaume Amélie Carlos Carmen Miguel Pilar Alejandro Dolores Sergio Consuelo Ignacio Raúl Giovanni Francesca Paolo Chiara Olga Dmitri Svetlana Igor Tatiana Agnieszka Krzysztof Małgorzata Zofia Jan Wei Ming Hiroshi Yuki Sakura Kenji Arjun Deepak Lakshmi Sanjay Anjali Mohammed Aisha Khalid Leila Hassan Zainab Kwabena Abena Oluwaseun Ngozi Thandiwe Sipho Mehmet Ayşe Emre Elif Dimitris Eleni Björn Freya Lars Astrid Jonas Joana Thiago Beatriz".split()
FAMILY = "Smith|Johnson|Williams|Brown|Jones|Miller|Davis|Wilson|Anderson|Taylor|Thomas|Moore|Martin|Jackson|Thompson|Harris|Clark|Lewis|Robinson|Walker|Allen|Wright|Scott|Nguyen|Adams|Nelson|Baker|Campbell|Mitchell|Roberts|Phillips|Evans|Turner|Parker|Collins|Edwards|Stewart|Morris|Murphy|Cook|Rogers|Müller|Schmidt|Schneider|Fischer|Weber|Wagner|Schulz|Hoffmann|Bauer|Koch|Richter|Wolf|Dubois|Durand|Lefèvre|Moreau|Girard|Bonnet|Rousseau|García|Rodríguez|Martínez|López|Sánchez|Pérez|Gómez|Díaz|Romero|Álvarez|Rossi|Bianchi|Ricci|Ivanov|Petrov|Kowalski|Wiśniewski|Zieliński|Novák|Dvořák|Wang|Chen|Zhang|Liu|Yang|Tanaka|Suzuki|Watanabe|Yamamoto|Sharma|Gupta|Patel|Singh|Kumar|Khan|Ahmed|Ali|Hussein|Mensah|Okonkwo|Nkosi|Dlamini|Yılmaz|Kaya|Papadopoulos|Hansen|Johansson|Andersson|Nilsson|Jensen|da Silva|dos Santos|de Souza|O’Brien|O'Connor|McCarthy|MacDonald|van Dijk|de Vries|van den Heuvel|de la Cruz|di Stefano|Le Goff|von Stein|el-Sayed|ben Amar".split("|")
#: Names that are words as well; both uses are in the table.
WORD_NAMES = "Will Rose Bill Grant Hope Frank Jack Dawn Faith Summer Art Pat Chase Miles Wade Reed Rich Sue Jasmine Ivy Olive Ruby Pearl Victor Max Guy Ray Gene Robin".split()

_ONSET = "b br c ch cl d dr f fl g gr h j k kl l m n p pr r s sh sk st t th tr v w y z".split()
_VOWEL = "a e i o u a e i o ai ea ie ou ei á é í ö ü å".split()
_CODA = ["", "", "", "l", "n", "r", "s", "m", "nd", "th", "ck", "rt", "x"]
_GIVEN_END = "a en in el ia ina is o us ette an ey iel ika lyn mar ric son us wen yn ita ine ou é".split()
_FAMILY_END = "son sen man mann berg feld stein wood ford ley ton well field burn quist ström gren ski sky wicz ová enko ov ini elli etti ez ier eau aux court worth more dale hart brook hurst combe idis akis oglu yan ura moto tani wala".split()
_TOWN_END = "ford ton ville stadt burg ham by mouth haven field minster brunn hausen court sur-Mer castle port lund vik bridge wick ness ingen".split()

_TEXT = {
    "noun": "garden invoice kitchen server contract meeting parcel report window engine lesson ticket budget train bridge printer recipe forest archive folder battery camera harbour factory market library elevator concert schedule bicycle catalogue storage backup database index queue pipeline cluster sensor turbine pump valve licence warranty shipment order delivery account balance policy claim survey study sample lecture exam chapter poem novel painting museum ferry tunnel road street lane square court drive box letter phone mail card form note file record list table plan job run test build version release branch page line key value entry object copy snapshot bucket batch chunk volume disk node rack shelf label manifest checksum digest review audit hold request answer message reply".split(),
    "adj": "old new green small late early broken empty heavy quiet yearly partial public private frozen warm cold sealed stale damaged missing spare main second final wooden modern silent golden silver amber crimson hidden northern rapid legal internal external open closed annual weekly nightly shared common strict basic global local".split(),
    "verb": "opened closed arrived failed started stopped moved waited grew fell broke finished changed returned stayed expired passed turned vanished improved froze".split(),
    "did": "repaired sold checked counted painted ordered cancelled moved measured replaced cleaned delivered copied rejected archived restored printed translated reviewed merged released deleted renamed verified tested scanned".split(),
    "acts": "forgot teaches bought sings cooked paints opened married visited plays wrote read finished repaired drove missed carried packed sold won hired helps knows brought takes gave kept met started studies watched cleaned chairs leads likes rides speaks owns needs wants designed borrowed found broke cancelled signed accepted refused tested measured moved planted translated photographed remembers misses defends".split(),
    "who": "the manager|the teacher|our team|the committee|a neighbour|the operator|the engineers|the night crew|the council|a visitor|the supplier|the bank|the postman|the tax office|the museum|an assistant|the front desk|nobody|everyone".split("|"),
    "unit": "kg km m cm mm g l ml s ms h min MB GB GiB TB KiB kWh W V A °C % EUR USD GBP rpm Hz bar pt px lines rows files days hours minutes weeks items pages votes points".split(),
    "month": "January February March April May June July August September October November December".split(),
    "day": "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split(),
    "animal": "Heron Falcon Otter Badger Lynx Raven Cedar Maple Comet Harbor Anchor Lantern Horizon Summit Glacier Canyon Meadow Ember Tiger Dolphin".split(),
    "colour": "Blue Red Green Silver Golden Amber Black White Crimson Purple Grey Scarlet Copper".split(),
    "org": "Bank|Clinic|University|Library|Museum|Institute|Insurance|Airlines|Foods|Logistics|Council|Institute of Technology|Town Hall|Station|Airport|Hospital|Theatre".split("|"),
    "head": "Annual|Open|Legal|Cold|Warm|Internal|Monthly|Change|Risk|Data|Access|Service|Project|Audit|Quality|Safety|Release|Storage".split("|"),
    "head2": "Report|Issues|Hold|Tier|Review|Summary|Desk|Pool|Log|Plan|Notes|Policy|Register|Window|Board|Budget|Overview|Calendar".split("|"),
    "haus": "Haus Garten Schule Woche Tage Monate Zahl Seiten Zimmer Strecke Brote Wasser Holz Fenster Tür Motor Preis Kosten Wetter Regen Menge Höhe Breite Länge Dauer Abfahrt Ankunft Meldung Antwort Frage Sitzung Prüfung Sendung Karte Kasse Halle Messung Stunden Minuten Meter Bücher Wartezeit Öffnungszeit Lieferfrist Gesamtsumme Werkstatt Eintrittskarten Handschuhe Rückgabe Druckerei Kündigung".split(),
    "path": "usr var home data tmp logs export images report street road lane photos raw final notes".split(),
    "ext": "csv pdf txt log xml json png jpg gz parquet docx".split(),
}


class Grammar:
    """Random values by rule; every choice comes from one seeded generator."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        pool = {"given": list(GIVEN), "family": list(FAMILY)}
        while len(pool["given"]) < 700:
            pool["given"].append(self._syllables(1, 2) + self._c(_GIVEN_END))
        while len(pool["family"]) < 700:
            pool["family"].append(self._syllables(1, 2) + self._c(_FAMILY_END))
        pool["given"] = [g[0].upper() + g[1:] for g in pool["given"]]
        pool["family"] = [f if " " in f or "-" in f else f[0].upper() + f[1:] for f in pool["family"]]
        self.pool = pool
        # A staff list has most names, not all: of the names made from syllables four in five, of the well-known ones half.
        listed = lambda names, known: {n for n in names if self.r.random() < (0.5 if n in known else 0.8)}
        self.listed = {"given": listed(pool["given"], set(GIVEN)) | set(WORD_NAMES), "family": listed(pool["family"], set(FAMILY))}

    def _c(self, options):
        return self.r.choice(options)

    def _p(self, chance: float) -> bool:
        return self.r.random() < chance

    def _n(self, low: int, high: int) -> str:
        return str(self.r.randint(low, high))

    def _digits(self, n: int, first: str = "123456789") -> str:
        return self._c(first) + "".join(self._c("0123456789") for _ in range(n - 1)) if n else ""

    def _hex(self, n: int) -> str:
        return "".join(self._c("0123456789abcdef") for _ in range(n))

    def _syllables(self, low: int, high: int) -> str:
        return "".join(self._c(_ONSET) + self._c(_VOWEL) + self._c(_CODA) for _ in range(self.r.randint(low, high)))

    def given(self) -> str:
        x = self.r.random()
        if x < 0.16:
            return self._c(WORD_NAMES)
        if x < 0.4:
            return self._c(GIVEN)
        name = self._c(self.pool["given"])
        return f"{name}-{self._c(self.pool['given'])}" if x > 0.95 else name

    def family(self) -> str:
        x = self.r.random()
        name = self._c(FAMILY) if x < 0.3 else self._c(self.pool["family"])
        if x > 0.94:
            return f"{name.split()[-1]}-{self._c(self.pool['family']).split()[-1]}"
        if x > 0.86:
            return self._c(["van ", "van der ", "van den ", "de ", "de la ", "von ", "Le ", "La ", "di ", "O’", "O'", "Mc", "al-", "St. "]) + self._c(self.pool["family"]).split()[-1]
        return name

    def town(self) -> str:
        t = self._syllables(1, 2).capitalize() + self._c([*_TOWN_END, "", "a", "o", "ov", "ice", "ola", "ín", "es", "ia"])
        if self._p(0.2):
            t = t.translate(str.maketrans({self._c("rnlszo"): self._c("řñłšžø")}))
        return self._c(["", "", "", "", "", "North ", "Upper ", "New ", "Saint ", "Port ", "Bad ", "Val-de-", "Sankt ", "San ", "Ciudad ", "Villa ", "Rio "]) + t

    def haus(self) -> str:
        """A German noun, joined of two at times: all of them have capitals."""
        n = self._c(_TEXT["haus"])
        return n + self._c(["", "s", "en"]) + self._c(_TEXT["haus"]).lower() if self._p(0.5) else n

    def person(self) -> str:
        g, f, x = self.given(), self.family(), self.r.random()
        if x < 0.5:
            out = f"{g} {f}"
        elif x < 0.59:
            out = f"{f}, {g}"
        elif x < 0.68:
            out = f"{g[0]}. {f}" if self._p(0.85) else f"{g[0]}.{self._c('ABDEHJKLMS')}. {f}"
        elif x < 0.75:
            out = f"{g} {self._c('ABCDEFGHJKLMNPRSTW')}. {f}"
        elif x < 0.79:
            out = f"{g} {self.given()} {f}"
        elif x < 0.83:
            out = f"{g}  {f}"
        elif x < 0.87:
            out = f"{f} {g}"
        elif x < 0.91:
            out = f"{g} {f}".upper()
        elif x < 0.975:
            out = (f"{g} {f}" if self._p(0.85) else f"{f}, {g}" if self._p(0.5) else f"{g[0]}. {f}").lower()
        else:
            out = f"{f.upper()} {g}"
        return f"[person_name|{out}]"

    def email(self) -> str:
        plain = lambda s: re.sub(r"[^a-z]", "", s.lower().translate(str.maketrans("áéíóúöüåäèêëïñçøł", "aeiououaaeeeincol")))
        g, f = plain(self.given()) or "info", plain(self.family()) or "desk"
        sep = self._c([".", ".", ".", "_", "-", ""])
        local = self._c([f"{g}{sep}{f}", f"{g}{sep}{f}", f"{g[0]}{sep}{f}", f"{g}{self._n(1, 99)}", f"{f}{sep}{g}", f"{g}", f"{f}", f"{g}{sep}{f}{self._n(1, 2000)}", self._c("info office sales support billing hr news team records admin contact".split())])
        if self._p(0.15):
            local += "+" + self._c(_TEXT["noun"])
        host = self._c([self._syllables(1, 3), self._c(_TEXT["noun"]) + self._c(["", "-"]) + self._c(_TEXT["noun"]), self._c(_TEXT["noun"]) + self._n(1, 9), self._syllables(1, 2) + "-" + self._c(_TEXT["noun"])])
        host = self._c(["", "", "", "mail.", "post.", "eu.", "staff."]) + host + "." + self._c("com org net example test invalid co.uk de fr es edu gov io co.jp example example invalid test".split())
        x = self.r.random()
        if x < 0.6:
            out = f"{local}@{host}"
            out = out.upper() if self._p(0.1) else out.title() if self._p(0.05) else out
        elif x < 0.76:
            at, dot = self._c([(" at ", " dot "), (" at ", " dot "), (" AT ", " DOT "), (" at ", ".")])
            out = (local.replace(".", dot) if self._p(0.7) else local) + at + host.replace(".", dot)
        elif x < 0.9:
            at, dot = self._c([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", "."), ("(at)", "."), (" {at} ", " {dot} "), (" <at> ", " <dot> ")])
            out = (local.replace(".", dot) if self._p(0.4) else local) + at + host.replace(".", dot)
        else:
            out = f"{local} @ {host}" if self._p(0.4) else f"{local}@{host}"
        return f"[email|{out.replace('[at]', '⟦at⟧').replace('[dot]', '⟦dot⟧')}]"

    def phone(self) -> str:
        d, sep = self._digits, self._c([" ", " ", "-", ".", "-", ""])
        x = self.r.random()
        if x < 0.2:  # North America
            area = self._c([f"({d(3)}) ", f"({d(3)})", d(3) + (sep or "-"), f"1{sep or '-'}{d(3)}{sep or '-'}", f"+1 {d(3)} ", f"+1 ({d(3)}) ", f"+1-{d(3)}-", f"+1.{d(3)}."])
            out = area + d(3) + (sep or "-") + d(4, "0123456789")
        elif x < 0.3:
            out = self._c([f"+{self._c(['1', '44', '49', '33', '34', '39', '31', '48', '81'])}{d(self.r.randint(9, 10))}", f"00{self._c(['44', '49', '33', '34'])}{sep}{d(3)}{sep}{d(7)}", d(10, "2345678")])
        elif x < 0.52:  # groups behind a country code
            s = sep or " "
            out = self._c(["+", "+", "00"]) + self._c("44 49 33 34 39 31 32 41 43 45 46 47 48 61 81 91 351 353 420".split()) + s + s.join(d(self.r.randint(2, 4), "0123456789") for _ in range(self.r.randint(2, 4)))
            out += "" if sum(c.isdigit() for c in out) > 8 else s + d(4)
        elif x < 0.6:
            s = sep or " "
            out = f"+{self._c(['44', '49', '43', '41'])} (0){self._c(['', ' '])}{d(2)}{s}{d(4)}{s}{d(4)}"
        elif x < 0.8:  # trunk zero
            s = sep or " "
            out = self._c([f"0{d(2)}{s}{d(4)}{s}{d(4)}", f"0{d(3)}{s}{d(3)}{s}{d(4)}", f"0{d(4)}{s}{d(6)}", f"(0{d(2)}) {d(4)} {d(4)}", f"0{d(2)}/{d(5)}{self._c(['', '-' + d(2)])}", f"0{d(3)}/{d(4)}-{d(3)}", f"(0{d(3)}) {d(6)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}", f"0{d(9)}"])
        elif x < 0.92:  # pairs or threes
            s = sep or " "
            out = self._c([f"0{self._n(1, 9)}{s}" + s.join(d(2, "0123456789") for _ in range(4)), f"{self._c('679')}{d(2)}{s}{d(3)}{s}{d(3)}", f"{self._c('69')}{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}{s}{d(3)}{s}{d(4)}"])
        else:
            out = f"{d(4)}{sep or '-'}{d(4)}" if self._p(0.6) else f"{d(3)}-{d(4)}"
        if self._p(0.12):
            out += self._c([" ext. ", " ext ", " x", " Ext. ", ", ext. ", " extension ", "-x"]) + self._n(2, 9999)
        return f"[phone|{out}]"

    def identity(self) -> tuple[str, str]:
        """(label, number): the label may stand before the number."""
        d, letter = self._digits, lambda n: "".join(self._c("ABCDEFGHJKLMNPRSTWXYZ") for _ in range(n))
        z = lambda n: d(n, "0123456789")
        code = lambda n: "".join(self._c("0123456789ABCDEFGHJKLMNPRTVWXYZ") for _ in range(n))
        mixed = lambda n: self._c([letter(1) + code(n - 2) + self._c("0123456789"), letter(2) + z(n - 2), letter(1) + z(n - 1), code(n - 1) + self._c("0123456789")])
        kind = self._c(["ssn", "ssn", "ssn", "ni", "ni", "tax", "tax", "passport", "passport", "passport", "national", "national", "insurance"])
        if kind == "ssn":
            s = self._c(["-", "-", "-", " "])
            first = f"{self._c([self.r.randint(1, 665), self.r.randint(667, 899)]):03d}"
            number = f"{first}{s}{self.r.randint(1, 99):02d}{s}{self.r.randint(1, 9999):04d}"
            number = number.replace(s, "") if self._p(0.2) else number
            label = self._c("SSN|SSN|social security number|Social Security No.|soc. sec. no.|social security|ID|identity number|".split("|"))
            return (label or "number") if s not in number else label, number
        if kind == "ni":
            s = self._c([" ", " ", ""])
            return self._c("NI number|National Insurance number|NINO|national insurance no.|insurance no.|insurance number|".split("|")), f"{letter(2)}{s}{z(2)}{s}{z(2)}{s}{z(2)}{s}{self._c('ABCD')}"
        if kind == "tax":
            return self._c("tax id|Tax ID|TIN|tax number|tax no.|Steuer-ID|Steuernummer|numéro fiscal|NIF|tax file number|IdNr.|Steuer-Nr.".split("|")), self._c([f"{d(2)} {z(3)} {z(3)} {z(3)}", f"{d(2)} {z(3)} {z(3)} {z(3)}", d(11), f"{d(3)} {z(3)} {z(3)}", f"{d(2)}/{z(3)}/{z(5)}", f"{d(2)}-{z(7)}", f"{d(10)}"])
        if kind == "passport":
            return self._c("passport|passport no.|passport number|Passport No|Passport|Pass-Nr.|Reisepass|Reisepass Nr.|passeport n°|pasaporte|pasaporte n.º|travel document".split("|")), self._c([mixed(9), mixed(9), mixed(8), mixed(9), d(9)])
        if kind == "insurance":
            return self._c("insurance number|insurance no.|health insurance no.|AHV-Nr.|Versichertennummer|n° de sécurité sociale|Sozialversicherungsnummer|NIR".split("|")), self._c([f"756.{z(4)}.{z(4)}.{z(2)}", f"{letter(1)}{z(9)}", f"{self._c('12')} {z(2)} {z(2)} {z(2)} {z(3)} {z(3)} {z(2)}", f"{z(2)} {z(6)} {letter(1)} {z(3)}", f"{z(2)}{z(6)}{letter(1)}{z(3)}"])
        return self._c("national id|national ID no.|DNI|NIE|ID card|ID no.|identity card|Personalausweis|carte d’identité|PESEL|BSN|CPF|personal number|ID number|documento".split("|")), self._c([f"{d(8)}{letter(1)}", f"{d(8)}-{letter(1)}", f"{self._c('XYZ')}{z(7)}{letter(1)}", f"{d(6)}-{z(4)}", d(11), f"{d(3)}.{z(3)}.{z(3)}-{z(2)}", f"{letter(3)}{z(6)}", f"{d(4)} {z(4)} {z(4)}", d(9)])

    def address(self) -> str:
        name = lambda: self._c([self._syllables(1, 2).capitalize(), self._c(_TEXT["animal"]), self._c(_TEXT["noun"]).capitalize(), self._c("Oak Elm Pine Church Mill Park High Station Victoria King’s Queen Chapel School Spring Hill River Lake Washington Lincoln Market Bridge".split()), self._c(self.pool["family"]).split()[-1]])
        n = self._n(1, 399) + (self._c("ABCDabc") if self._p(0.25) else "") if self._p(0.9) else self._n(400, 19999)
        end = lambda: self._c(["", "", f", {self.town()}", f", {self.town()} {self._n(10000, 99999)}", f", {self.town()}, {self._c('CA NY TX OR WA MA IL OH FL'.split())} {self._n(10000, 99999)}", f", {self.town()} {self._c('ABLMSNE')}{self._c('ABELSW')}{self._n(1, 28)} {self._n(1, 9)}{self._c('ABDHJ')}{self._c('BDHQX')}", f", {self.town()}"])
        unit = lambda: self._c(["", "", "", f", {self._c(['Apt', 'Apt.', 'Unit', 'Suite', 'Flat', 'Room', 'Floor', 'Ste'])} {self._c([self._n(1, 400), self._n(1, 20) + self._c('ABC'), self._c('ABCD')])}", f" #{self._n(1, 99)}"])
        x = self.r.random()
        if x < 0.44:
            kind = self._c("Street St St. Avenue Ave Ave. Road Rd Rd. Lane Ln Drive Dr Boulevard Blvd Court Ct Place Square Terrace Way Close Crescent Gardens Parkway Row Walk Grove Quay Mews Rise Hill".split())
            two = f"{self._c(['North', 'South', 'East', 'West', 'Old', 'Upper', 'N', 'W.'])} " if self._p(0.12) else ""
            out = f"{n} {two}{name()}{' ' + name() if self._p(0.12) else ''} {kind}{self._c([' NW', ' SE', ' N']) if self._p(0.05) else ''}"
            out = out.upper() if self._p(0.04) else out.lower() if self._p(0.03) else out
            first = f"{self._c(['Flat', 'Unit', 'Apartment', 'Suite', 'Room', 'Apt'])} {self._c([self._n(1, 90), self._n(1, 20) + self._c('ABC')])}, " if self._p(0.07) else ""
            out = first + out + ("" if first else unit()) + end()
        elif x < 0.54:
            out = f"{self._c(['PO Box', 'P.O. Box', 'P. O. Box', 'Post Office Box', 'P.O.Box', 'PO box'])} {self._n(1, 9999)}{end()}"
        elif x < 0.58:
            out = self._c([f"Postfach {self._n(10, 9999)}, {self._n(10000, 99999)} {self.town()}", f"BP {self._n(10, 999)}, {self._n(10000, 99999)} {self.town()}", f"Apartado {self._n(10, 999)}, {self.town()}"])
        elif x < 0.74:
            kind = self._c("rue avenue boulevard place chemin allée impasse quai route Rue Avenue Boulevard cours".split())
            of = self._c(["de la ", "du ", "des ", "de l’", "de ", "", "d’", "de l'"])
            out = f"{self._n(1, 199)}{self._c(['', '', ',', ' bis', ' ter', ' B'])} {kind} {of}{name()}{' ' + name() if self._p(0.15) else ''}{self._c(['', f', {self._n(10000, 99999)} {self.town()}', f', {self._n(10000, 99999)} {self.town()}', f' à {self.town()}'])}"
        elif x < 0.86:
            kind = self._c("Calle Avenida Av. Plaza Paseo Camino C/ Carrer Ronda Via Viale Piazza calle plaza Rua".split())
            of = self._c(["de la ", "del ", "de los ", "de ", "", "", "della "])
            more = self._c(["", "", f", {self._n(1, 9)}.º {self._c('ABCD')}", f", {self._n(1, 9)}º {self._c('ABCD')}", f", piso {self._n(1, 9)}", f", {self._n(1, 9)}ª planta"])
            out = f"{kind}{'' if kind == 'C/' and self._p(0.5) else ' '}{of}{name()}{self._c([' ', ' ', ', ', ', n.º '])}{self._n(1, 199)}{more}{self._c(['', f', {self._n(10000, 99999)} {self.town()}', f', {self.town()}'])}"
        else:
            stem = self._syllables(1, 2).capitalize()
            street = self._c([stem + self._c("straße strasse str. weg allee platz gasse damm ring ufer hof steig graben wall pfad".split()), f"{self._c(['Am', 'An der', 'Im', 'Auf dem', 'Zum', 'Unter den', 'Alte', 'Neue', 'Lange'])} {self._c(['Markt', 'Bach', 'Kirche', 'Linden', 'Hafen', 'Berg', 'Tor', 'Gasse', 'Ufer', 'Straße', stem])}", f"{stem}er {self._c(['Straße', 'Weg', 'Allee', 'Platz', 'Str.', 'Chaussee'])}", f"{stem}{self._c(['straat', 'laan', 'gracht', 'weg', 'gatan', 'vägen', 'plein'])}"])
            out = f"{street} {self._n(1, 199)}{self._c(['', '', 'a', ' b', '–' + self._n(2, 9)])}{self._c(['', f', {self._n(10000, 99999)} {self.town()}', f', {self._n(1000, 9999)} {self.town()}', f' in {self._n(10000, 99999)} {self.town()}'])}"
        return f"[street_address|{out}]"

    # Text without mentions.

    def number(self) -> str:
        n, d = self._n, self._digits
        return self._c([n(0, 9), n(10, 99), n(100, 99999), f"{n(1, 99)}.{n(0, 999)}", f"{n(1, 99)},{n(100, 999)}", f"{n(1, 99)},{n(100, 999)},{n(100, 999)}", f"{n(1, 100)}%", f"{n(1, 100)} %", d(self.r.randint(6, 12))])

    def thing(self) -> str:
        """A number or name of something that is no mention."""
        n, d, h = self._n, self._digits, self._hex
        date = f"{n(1990, 2030)}-{self.r.randint(1, 12):02d}-{self.r.randint(1, 28):02d}"
        w = lambda: self._c(_TEXT["noun"])
        return self._c([
            date, f"{date}T{self.r.randint(0, 23):02d}:{self.r.randint(0, 59):02d}Z", f"{n(1, 28)}.{n(1, 12)}.{n(1990, 2030)}", f"{n(1, 12)}/{n(1, 28)}/{n(1990, 2030)}", f"{self.r.randint(0, 23):02d}:{self.r.randint(0, 59):02d}", f"{self.r.randint(0, 23):02d}.{self.r.randint(0, 59):02d}", f"{self.r.randint(0, 23):02d}:{self.r.randint(0, 59):02d}:{self.r.randint(0, 59):02d} UTC",
            f"{n(0, 12)}.{n(0, 30)}.{n(0, 99)}", f"{n(0, 12)}.{n(0, 30)}.{n(0, 99)}.{n(1000, 9999)}", f"v{n(1, 9)}.{n(0, 20)}", f"{n(1, 255)}.{n(0, 255)}.{n(0, 255)}.{n(1, 254)}", f"{n(10, 192)}.{n(0, 2)}.{n(0, 9)}.{n(1, 254)}", h(8), h(16), h(24), h(32), h(40), f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}", f"{w()}-{h(6)}", f"{w()[0]}{h(6)}", f"{w()[:3]}_{h(4)}", f"{w()}/{h(6)}", f"{w()[:2]}-{h(6)}",
            f"/{self._c(_TEXT['path'])}/{self._c(_TEXT['path'])}/{n(1, 999)}/{w()}.{self._c(_TEXT['ext'])}", f"{w()}/{w()}-{self._digits(5, '0123456789')}.{self._c(_TEXT['ext'])}", f"{w()}/{w()}/{w()}/{w()}-{self._digits(5, '0123456789')}.{self._c(_TEXT['ext'])}", f"{w()}.{self._c(_TEXT['ext'])}", f"{w()}_{n(1, 99)}.{self._c(_TEXT['ext'])}", f"https://{w()}.example/{w()}/{n(1, 999)}", f"www.{w()}.org",
            f"{self._c(['@', '#'])}{w()}", f"{w()}@{n(1, 9)}.{n(0, 9)}", f"{w()}@v{n(1, 99)}", f"{w()}@", f"@{w()}.{w()}", f"@{w()}", f"--{w()}", f"{w()}-{n(1, 99)}", f"{n(100, 999)}-{n(1, 9)} per {n(10, 1000)}", f"{n(0, 9)}{n(0, 9)}{n(0, 9)}/{n(1000, 9999)}-{n(1, 99)}", f"{n(1, 9)}-{n(1, 9)}", f"{n(1900, 2030)}/{n(10, 99)}", f"{n(1900, 2030)}–{n(1900, 2030)}", f"{n(1990, 2030)}-{self.r.randint(1, 12):02d}-{n(100, 140)}",
            f"{w().upper()[:3]}{d(7)}", f"{d(4)}-{d(4)}", f"{d(10)}", f"{d(10)}", f"{d(12)}", f"{d(3)}-{d(1)}", f"#{d(5)}", f"{d(5)}/{d(2)}", f"{n(1, 90)}.{d(4)}, {n(1, 90)}.{d(4)}", f"{n(1, 99)} {self._c(_TEXT['unit'])}", f"{n(1, 99)}.{n(0, 999)} {self._c(_TEXT['unit'])}", f"{n(1, 9)} x {n(10, 99)} {self._c(_TEXT['unit'])}", f"{n(0, 9)}:{n(0, 9)}", f"{self._c('ABCR')}{n(1, 99)}", f"ISBN {n(900, 999)}-{n(0, 9)}-{n(10, 99)}-{d(6)}-{n(0, 9)}", self._c("I II III IV V VI VII VIII IX X XI".split()), f"0x{h(6)}", f"{h(32)}{h(32)}", "".join(self._c("ABCDEFGHKLMNPQRSTabcdefghklmnpqrst0123456789+/") for _ in range(self.r.randint(30, 90))) + self._c(["", "=", "=="]),
        ])

    def proper(self) -> str:
        """A capitalised name of something that is no person."""
        t, c = self.town, self._c
        return c([
            f"Project {c(_TEXT['colour'])} {c(_TEXT['animal'])}", f"{c(_TEXT['colour'])} {c(_TEXT['animal'])}", f"{t()} {c(_TEXT['org'])}", f"{c(_TEXT['head'])} {c(_TEXT['head2'])}", f"{c(_TEXT['head'])} {c(_TEXT['head2'])}", f"the {t()} {c(_TEXT['noun'])}", f"the {c(_TEXT['colour'])} {c(_TEXT['animal'])} Hotel", f"Lake {t()}", f"Mount {t()}", f"{t()}", f"{t()}", f"{c(_TEXT['noun']).capitalize()} {c(_TEXT['noun']).capitalize()}", f"{self._syllables(1, 2).capitalize()} {c(['Inc.', 'Ltd', 'GmbH', 'AG', 'Corp', 'SA', '& Sons'])}", f"{self._syllables(1, 2).capitalize()} {c(['Pro', 'Max', 'Cloud', 'Server', 'Linux', 'Drive', '3000'])}",
        ])

    def plain(self) -> str:
        """A sentence without mentions."""
        c, t = self._c, self.thing
        noun, adj, verb, did = (lambda k=k: c(_TEXT[k]) for k in ("noun", "adj", "verb", "did"))
        who = c(_TEXT["who"])
        Who = who[0].upper() + who[1:]
        month, day, town, w = c(_TEXT["month"]), c(_TEXT["day"]), self.town(), c(WORD_NAMES)
        num, unit = self.number, c(_TEXT["unit"])
        return c([
            lambda: f"The {adj()} {noun()} {verb()} after {num()} {unit}.", lambda: f"{Who} {did()} {num()} {adj()} {noun()}s.", lambda: f"{Who} {did()} the {noun()} {t()}, and the {adj()} {noun()} {verb()}.", lambda: f"In {town} {who} {did()} {num()} {noun()}s.", lambda: f"{noun().capitalize()} {t()} {verb()} at {t()}.", lambda: f"{noun().capitalize()} {t()} {verb()}; {num()} of {num()} {noun()}s were {did()}.",
            lambda: f"In {month} {who} {did()} {num()} {noun()}s.", lambda: f"Since {month} nothing {verb()}.", lambda: f"The {month} {noun()} {verb()} on {day}.", lambda: f"On {day} the {noun()} at {town} {verb()} by {num()} {unit}.", lambda: f"{month} {self._n(1, 28)}: the {noun()} {verb()}.", lambda: f"From {month} to {c(_TEXT['month'])} the {noun()} {verb()}.",
            lambda: f"{self.proper()} and {self.proper()} are {c(['two chapters', 'films', 'teams', 'two sections', 'songs', 'places', 'brands'])}.", lambda: f"{self.proper()} is {c(['a code name', 'the working title', 'a product', 'a chapter', 'a film', 'a ship', 'a town', 'our team', 'a brand', 'the next song'])}.", lambda: f"{c(['See', 'Read', 'Open', 'Visit'])} {self.proper()} for the {noun()}.", lambda: f"{Who} {c(['works at', 'visited', 'left', 'joined', 'wrote to', 'sued'])} {self.proper()}.", lambda: f"{self.proper()} {c(['opened', 'closed', 'lies', 'stands', 'ships'])} {c(['in', 'near', 'north of'])} {town}.", lambda: f"{Who} travelled from {town} to {self.town()} in {num()} hours.", lambda: f"{town} had {num()} inhabitants in {self._n(1800, 2030)}.", lambda: f"{c(['Snow', 'Rain', 'Traffic', 'Prices', 'Visitors'])} near {town} rose by {num()} {unit}.", lambda: f"The {noun()} of {town} {verb()} in {self._n(1800, 2030)}.", lambda: f"Tickets to {town} cost {num()} EUR, children pay {num()}.", lambda: f"{c(['Prices', 'Rents', 'Fares', 'Taxes', 'Plans', 'The forecast', 'The bill', 'The map'])} for {town} {c(['rose to', 'fell below', 'show', 'came in at'])} {num()} {unit}.", lambda: f"{town}, {self.town()} and {self.town()} {c(['lie', 'grew', 'voted'])} {c(['inland', 'together', 'twice'])}.",
            lambda: f"{c(['Bill', 'Grant', 'Chase', 'Frank', 'Sue', 'Pat', 'Will'])} the {noun()} {c(['first', 'for', 'at', 'into', 'with'])} {adj()} {noun()}s.", lambda: f"{c(['Chase', 'Grant', 'Bill', 'Sue', 'Pat'])} {c(['every', 'all', 'each', 'any', 'a', 'no', 'our'])} {noun()} that {verb()}.", lambda: f"{Who} will {c(['grant', 'bill', 'chase', 'hope'])} {num()} {noun()}s in {month}.", lambda: f"{c(['Hope', 'Faith', 'Dawn', 'Summer', 'Art', 'Rose', 'Ivy', 'Pearl'])} {c(['is', 'was', 'and'])} {c(['not', 'a', 'the', 'early', 'only'])} {noun()} for {who}.", lambda: f"{num()} days later the {noun()} {verb()}.", lambda: f"Will the {noun()} be {did()} in {month}?", lambda: f"The {c(['rose', 'dawn', 'summer', 'ruby', 'olive', 'art', 'grant', 'bill', 'reed', 'jack', 'ray', 'gene', 'robin'])} {verb()} near the {noun()}.", lambda: f"{c(['A', 'The'])} {w.lower()} {noun()} {verb()}.",
            lambda: f"The {c(['total', 'meter', 'odometer', 'epoch', 'sum', 'balance'])} {c(['came to', 'read', 'was', 'exceeded'])} {self._digits(self.r.randint(9, 11))} {c(['', unit, noun() + 's'])}.", lambda: f"The {noun()} id is {self._digits(self.r.randint(8, 12))}.", lambda: f"{c(['Order', 'Ticket', 'Invoice', 'Serial number', 'Batch', 'Part', 'Case', 'Booking', 'Tracking number', 'Article', 'Code', 'Key'])} {c(['', 'no. ', 'number ', '# '])}{t()} was {did()}.", lambda: f"{c(['Section', 'Ratio', 'Score', 'Paragraph', 'Rule', 'Exercise'])} {t()}, {c(['answer', 'grade', 'level'])} {t()}.", lambda: f"The commit {self._hex(12)} weighs {num()} {unit}.", lambda: f"Between {self._digits(9)} and {self._digits(10)}{c(['', '000'])} nothing {verb()}.",
            lambda: f"{c(['Lane', 'Drive', 'Street', 'Square', 'Court', 'Box', 'Room', 'Floor', 'Platform', 'Way', 'Row', 'Unit', 'Road', 'Place'])} {self._n(1, 40)} of the {noun()} {verb()} for {num()} {unit}.", lambda: f"{c(['Street', 'Road', 'Square', 'Court', 'Lane'])} {noun()}s {c(['cost', 'need', 'weigh'])} {num()} {unit}.", lambda: f"Under {t()} there are {num()} {noun()}s.", lambda: f"The road to {town} is {num()} km long.", lambda: f"{Who} counted {num()} streets, {num()} lanes and {num()} squares in {town}.", lambda: f"The {noun()} has {num()} rooms on {num()} floors.", lambda: f"Box {num()} and drive {num()} were {did()} by {who}.",
            lambda: f"Look at the {noun()} at {t()}, not at the dot.", lambda: f"The dot at the end of {t()} is {adj()}.", lambda: f"Follow @{noun()} and install {noun()}@{c(['v', '', '^'])}{self._n(1, 20)}.{self._n(0, 9)} from the {noun()}.", lambda: f"{c(['Type', 'Add', 'Use'])} {c(['@', 'git@', 'root@', '@all'])} before the {noun()}.", lambda: f"{Who} arrived at {town} at {t()}.", lambda: f"The {noun()} at {noun()}.{c(_TEXT['ext'])} was {did()}.",
            lambda: f"“{c(['Not', 'Never', 'Maybe'])} {c(['again', 'yet', 'today'])},” {who} {c(['said', 'wrote'])}.", lambda: f"When will {who} {c(['open', 'paint', 'sell', 'print'])} the {noun()}?", lambda: f"It {verb()} although the {noun()} {verb()}.", lambda: f"{c(['We’ve', 'They have', 'I’ve', 'Nobody has'])} {did()} the {adj()} {noun()}, but don’t {c(['like', 'need', 'want'])} it.", lambda: f"{c(['Please', 'Do not', 'Always', 'Never'])} {c(['open', 'close', 'move', 'delete', 'copy'])} their {adj()} {noun()} near {t()} until {who} {c(['agrees', 'returns', 'pays'])}.", lambda: f"{num()} {noun()}s and {num()} {noun()}s {verb()} until {t()}.", lambda: f"{noun().capitalize()}s {self._n(1, 99)} and {self._n(100, 9999)} {c(['look', 'feel', 'seem'])} {adj()}.",
            lambda: f"- {noun().capitalize()} {t()} {verb()}", lambda: f"## {c(_TEXT['head'])} {c(_TEXT['head2'])}", lambda: f"{noun()}_{noun()} = {t()}", lambda: f"{noun()}: {t()}", lambda: f"[{t()}] INFO {noun()}.{noun()} {did()} {num()} {noun()}s", lambda: f"{noun()}={num()} {noun()}={t()} state={verb()}", lambda: f'{{"{noun()}": "{t()}", "{noun()}": {num()}}}', lambda: f"{noun()};{num()};{t()};{verb()}",
            lambda: f"Der {c(['Bericht', 'Server', 'Zug', 'Vertrag', 'Dienst', 'Antrag', 'Schlüssel'])} {t()} wurde in {town} um {t()} {c(['geprüft', 'gelöscht', 'verschoben', 'bestätigt', 'gedruckt'])}.", lambda: f"{c(['Die', 'Eine'])} {c(['Brücke', 'Lieferung', 'Prüfsumme', 'Rechnung', 'Sicherung', 'Tabelle'])} hat {num()} {c(['Einträge', 'Seiten', 'Meter', 'Zeilen'])}, obwohl {c(['der Keller', 'die Halle', 'das Regal', 'der Wagen'])} leer ist.", lambda: f"Größe {num()} {unit}, {c(['Übergabe', 'Abnahme', 'Kontrolle'])} in {town} {c(['bestätigt', 'verweigert'])}.", lambda: f"{c(['Wir brauchen', 'Es fehlen', 'Bestellt sind', 'Gezählt wurden'])} {num()} {c(_TEXT['haus'])} und {num()} {c(_TEXT['haus'])}.", lambda: f"Ab {num()} {c(_TEXT['haus'])} {c(_TEXT['haus'])} wird die {c(_TEXT['haus'])} {c(['teurer', 'geschlossen', 'verlegt'])}.", lambda: f"{c(_TEXT['haus'])} {t()}: {num()} {c(_TEXT['haus'])}, {c(_TEXT['haus'])} {t()}, {c(_TEXT['haus'])} aus {town}.", lambda: f"{c(['Die', 'Der', 'Das'])} {c(_TEXT['haus'])} {c(['von', 'ohne', 'der', 'mit'])} {c(_TEXT['haus'])} {t()} {c(['kostet', 'dauert', 'misst', 'braucht'])} {num()} {c(_TEXT['haus'])} mehr.", lambda: f"{c(['Bitte', 'Morgen', 'Danach', 'Nach'])} {num()} {c(_TEXT['haus'])} {c(['Pause', 'Fahrt', 'Ruhe'])} {c(['halten', 'machen', 'warten'])}; {c(_TEXT['haus'])} {t()} bleibt zu.", lambda: f"{self.haus()} {c(['bisher', 'heute', 'neu', 'laut Plan'])}: {num()} {self.haus()} {self.haus()}, {c(['sonst', 'dann', 'später'])} {c(['gratis', 'teurer', 'zu', 'wird es eng'])}.", lambda: f"{self.haus()}: {num()} {self.haus()}, {self.haus()} {t()}, {c(['erledigt', 'offen', 'neu'])}.", lambda: f"Im {c(['Januar', 'März', 'Mai', 'Juli', 'Oktober'])} wurden {num()} {c(['Dateien', 'Blumen', 'Bücher', 'Anträge'])} {c(['gezählt', 'verkauft', 'verworfen'])}.",
            lambda: f"Le {c(['train', 'rapport', 'service', 'dossier', 'serveur', 'contrat'])} {t()} a {c(['traité', 'perdu', 'vérifié', 'déplacé'])} {num()} {c(['entrées', 'pages', 'clés', 'copies'])} à {town}.", lambda: f"{c(['Le matin', 'Depuis'])} {t()}, {c(['le jardin', 'la porte', 'le pont', 'la place'])} {c(['reste libre', 'semble vide', 'attend'])} pour {num()} {unit}.", lambda: f"{c(['La maison', 'La facture', 'Une copie'])} {t()} vient de {town}.", lambda: f"{c(['Prix', 'Pluie', 'Arrivée', 'Visite', 'Départ', 'Marché', 'Facture'])} {c(['à', 'de', 'pour'])} {town} : {num()} {unit}, {c(['entrée libre', 'complet', 'billets en vente', 'fin à midi'])}.", lambda: f"{c(['Precio', 'Lluvia', 'Llegada', 'Visita'])} {c(['en', 'a', 'de'])} {town}: {num()} {unit}.", lambda: f"El {c(['tren', 'informe', 'barco', 'servidor', 'contrato'])} {t()} {c(['llevó', 'perdió', 'movió'])} {num()} {c(['claves', 'páginas', 'copias'])} en {town}.", lambda: f"{c(['Hasta', 'Desde'])} el {c(['lunes', 'viernes', 'mes'])} {t()}, {c(['la puerta', 'el barco', 'la tienda'])} no {c(['abrió', 'salió', 'llegó'])}.", lambda: f"La {c(['carta', 'factura', 'puerta'])} {t()} está {c(['perdida', 'cerrada', 'rota'])} en {town}.",
        ])()

    # Text with mentions.

    def marked(self) -> str:
        """A sentence or a few lines with mentions."""
        c, P, E, T, A = self._c, self.person, self.email, self.phone, self.address
        G, F = (lambda: f"[person_name|{self.given()}]"), (lambda: f"[person_name|{self.family()}]")
        noun, adj, did = (lambda k=k: c(_TEXT[k]) for k in ("noun", "adj", "did"))

        def ident(labelled: float = 0.75) -> str:
            label, number = self.identity()
            bare = re.fullmatch(r"\d{3}[- ]\d\d[- ]\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d\d \d{3} \d{3} \d{3}|\d{8}[A-Z]", number)
            shown = f"[identity_number|{number}]"
            return shown if bare and not self._p(labelled) or not label else label + c([" ", " ", ": ", " is ", " number " if "n" not in label[-4:] and " " not in label else " ", "# " if label.isupper() else " "]) + shown

        num_only = lambda: f"[identity_number|{self.identity()[1]}]"
        title = lambda: c(["Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Dr", "Dr.", "Prof.", "Professor", "Miss", "Sir", "Judge", "Captain", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sra.", "Sr.", "Don", "Nurse", "Officer"])
        role = lambda: c("the tenant|the patient|the driver|our accountant|the owner|a lawyer|a witness|the caller|the applicant|my colleague|my sister|our neighbour|the author|the guardian|the new engineer|the reviewer|the buyer|the teacher|a student named|the sender|the trustee|the painter|the heir".split("|"))
        said = lambda: c("said|wrote|called|asked|confirmed|signed the form|left early|moved out|has agreed|will come later|lost the key|sent a note|explained the plan|approved the budget|has not replied|joined us|reported the damage|works here|lives nearby|answered|checked the list|paid the bill|noted the time|handed over the keys".split("|"))
        when = lambda: c(["", "", f" on {c(_TEXT['day'])}", " yesterday", " this morning", f" in {c(_TEXT['month'])}", " twice", " by phone", " last week", " asap", " before noon"])
        end = lambda: c([".", ".", ".", "", "!", "?"])
        about = lambda: f"about the {adj()} {noun()}"
        who = lambda: c([P, P, P, G, lambda: f"{title()} {F()}", lambda: f"{title()} {P()}"])()
        reach = lambda: c([lambda: f"({E()})", lambda: f"({T()})", lambda: f"at {E()}", lambda: f"on {T()}", lambda: f"at {T()}", lambda: f"under {T()}", lambda: f"by mail to {E()}", lambda: f"<{E()}>", lambda: f"at {E()} or {T()}", lambda: f"on {T()} or at {E()}", lambda: f", {T()}", lambda: f"via {E()}"])()
        field = {
            "Name": lambda: P(), "Full name": lambda: P(), "Contact": lambda: P(), "Guest": lambda: P(), "Owner": lambda: P(), "Attn": lambda: P(), "From": lambda: c([P, lambda: f"{P()} <{E()}>", E])(), "To": lambda: c([P, E, lambda: f"{E()}, {E()}"])(), "Cc": lambda: c([E, lambda: f"{E()}; {E()}", lambda: f"{P()} <{E()}>"])(), "Answer to": lambda: E(), "E-mail": lambda: E(), "Email": lambda: E(), "Mail": lambda: E(), "Phone": lambda: T(), "Tel.": lambda: T(), "Tel": lambda: T(), "Mobile": lambda: T(), "Fax": lambda: T(), "Address": lambda: A(), "Street": lambda: A(), "Ship to": lambda: c([A, lambda: f"{P()}, {A()}"])(), "Residence": lambda: A(), "Telefon": lambda: T(), "Anschrift": lambda: A(), "Adresse": lambda: A(), "Téléphone": lambda: T(), "Courriel": lambda: E(), "Correo": lambda: E(), "Teléfono": lambda: T(), "Dirección": lambda: A(), "Kunde": lambda: P(), "Nombre": lambda: P(), "Nom": lambda: P(), "ID": lambda: num_only(), "Id": lambda: num_only(), "SSN": lambda: num_only(), "Passport": lambda: num_only(), "Tax ID": lambda: num_only(),
        }
        any_field = lambda: (lambda k: f"{k}{c([': ', ': ', ':', ' - ', ' = '])}{field[k]()}")(c(list(field)))
        one = lambda: c([P, P, E, T, A, ident, num_only])()
        return c([
            lambda: f"{who()} {said()}{when()}{end()}", lambda: f"{who()} {said()} {about()}{when()}{end()}", lambda: f"{who()} {said()} {reach()}{end()}", lambda: f"{c(['I spoke with', 'We met', 'She lives with', 'They hired', 'Ask', 'Ask for', 'Call', 'Contact', 'Notify', 'Thank', 'Tell', 'Remind', 'Look for', 'He works with', 'It belongs to', 'I’ll inform', 'Please inform', 'Turn to', 'Hand it to', 'A copy goes to'])} {who()} {about()}{when()}{end()}", lambda: f"{c(['Ask', 'Call', 'Invite', 'Please call', 'Turn to', 'Wake', 'Send it to', 'Pass it to', 'Wait for', 'Report to'])} {c([P, G])()} {c(['or', 'and'])} {c([P, G])()} {c(['when the', 'once the', 'before the', 'because the'])} {noun()} {c(_TEXT['verb'])}{end()}",
            lambda: f"{c(['Ask', 'Call', 'Contact', 'Please contact', 'Reach', 'Questions? Ask', 'Write to'])} {who()} {reach()}{when()}{end()}", lambda: f"{who()} {c(_TEXT['acts'])} {c(['the', 'his', 'her', 'a', 'our', 'their', 'every', 'no'])} {c(['', '', adj() + ' '])}{noun()}{when()}{end()}", lambda: f"{who()} {c(_TEXT['acts'])} the {noun()}; {who()} {c(_TEXT['acts'])} {c(['it', 'the ' + noun(), 'nothing', 'music', 'chemistry', 'Spanish'])}{when()}{end()}", lambda: f"{c(['Could', 'Can', 'Will', 'Did', 'Should', 'Why did', 'When does', 'Has', 'Was'])} {c([G, P, G])()} {c('bring open sell find move sign call help join read see send'.split())} {c(['it', 'the ' + noun(), 'us', 'them'])}{when()}?", lambda: f"{c(['Her', 'His', 'My', 'Our', 'Their', 'The new'])} {c('assistant|dentist|brother|uncle|coach|boss|lawyer|neighbour|niece|doctor|mentor|partner|cousin|wife|husband|editor'.split('|'))}{c([' is ', ' was ', ', ', ' '])}{c([P, G])()}{c(['', ', ' + said(), ' ' + c(_TEXT['acts']) + ' the ' + noun()])}{end()}", lambda: f"{P()}, {P()} and {P()} {said()}{end()}", lambda: f"{c([P, G])()} and {c([P, G])()} {c(_TEXT['acts'])} the {noun()}{when()}{end()}", lambda: f"With {c([P, G])()} {c(['away', 'in charge', 'on leave', 'at the desk'])}, {c([P, G])()} {c(_TEXT['acts'])} the {noun()}.", lambda: f"{c(['The', 'Our', 'Your', 'A'])} {noun()} was {did()} by {who()}{when()}{end()}", lambda: f"The {noun()} {c(['for', 'of', 'from', 'by', 'with'])} {who()} was {did()}{when()}{end()}", lambda: f"{(lambda x: x[0].upper() + x[1:])(role())} {c(['', 'is ', 'was '])}{who()}{c(['', ' ' + reach(), ', ' + A()])}{end()}", lambda: f"{(lambda x: x[0].upper() + x[1:])(role())}, {who()}, {said()}{when()}{end()}", lambda: f"{c('Driver|Attorney|Engineer|Teacher|Student|Author|Tenant|Curator|Plaintiff|Applicant|Passenger|Coach|Claimant|Chairman|Detective|Poet|Painter|Customer|Member|Senator'.split('|'))} {P()} {said()}{when()}{end()}", lambda: f"The {c('driver|attorney|engineer|signature of|mother of|desk of|office of|estate of|student|letter to|claim of|coach'.split('|'))} {P()} {c(['was', 'is', 'stays'])} {adj()}{end()}", lambda: f"{noun().capitalize()} for {P()}: {c([T, E, A, ident])()}",  lambda: f"{(lambda x: x[0].upper() + x[1:])(role())} {P()} {said()} {c(['and', 'but'])} {P()} {said()}{end()}",
            lambda: f"“{title()} {F()} {said()},” {c(['she', 'he', 'they'])} {c(['said', 'told us'])}.", lambda: f"“{c(['I saw', 'Ask', 'It was'])} {c([G, P])()},” {c(['said', 'wrote'])} {c([G, P])()}.", lambda: f"{c(['Dear', 'Hello', 'Hi', 'Good morning', 'Hey', 'Liebe', 'Lieber', 'Sehr geehrte Frau', 'Sehr geehrter Herr', 'Cher', 'Chère', 'Querido', 'Estimada'])} {c([P, G, F])()},{c([chr(10), ' ', chr(10)])}{c(['your', 'the', 'our'])} {noun()} was {did()}.", lambda: f"{c(['Thanks', 'Regards', 'Best regards', 'Yours', 'Cheers', 'Kind regards', 'Sincerely', 'Best', 'Grüße', 'Cordialement', 'Saludos'])},{c([chr(10), ' ', chr(10)])}{c([G, G, P])()}{c(['', '', chr(10) + self.plain(), chr(10) + T(), ' ' + self.plain()])}", lambda: f"{c(['hi', 'hey', 'hello', 'ok', 'yo'])} {c(['its', 'this is', ''])} {P()}{c([' here', ' again', ' speaking'])}{c([',', '.', ' -'])} {c(['can u', 'please', 'could you'])} {c(['text', 'ping', 'ring', 'call me on', 'try'])} {T()} {c(['tonight', 'today', 'thx', ''])}".replace("  ", " "),
            lambda: f"{c(['Call', 'Dial', 'Phone', 'Text', 'Ring', 'Try'])} {T()} {c(['now', 'for help', 'after six', 'and ask for ' + G(), 'or write to ' + E()])}{end()}", lambda: f"{c(['The caller', 'A customer', 'She', 'He', 'Somebody', 'The visitor'])} left {T()} and {c(['hung up', 'wants a reply', 'needs help', 'nothing else'])}{end()}", lambda: f"{c(['My', 'Her', 'His', 'Our', 'The'])} {c(['number', 'phone', 'phone number', 'new number', 'mobile', 'fax', 'cell', 'direct line'])} {c(['is', 'was', 'remains'])} {T()}{end()}", lambda: f"Either {T()} or {T()} {c(['works', 'is right', 'reaches us'])}{end()}",
            lambda: f"{c(['Write to', 'Send the ' + noun() + ' to', 'Reply to', 'Mail', 'Forward this to', 'Copy', 'Subscribe at', 'Sent by', 'From', 'Mail us:', 'mailto:' if self._p(0.5) else 'Contact'])} {E()}{when()}{end()}".replace("mailto: ", "mailto:"), lambda: f"{c(['My', 'Her', 'His', 'Our', 'The'])} {c(['address', 'e-mail', 'mail address', 'email address', 'mailbox'])} is {E()}{end()}", lambda: f"{c(['cc', 'cc:', 'bcc', 'to', 'for'])} {E()}{c([';', ',', ' and'])} {E()}", lambda: f"{c(['mailto:', '<', '(', '“'])}{E()}{c([' is full', '> wrote:', ')', '”', ' failed'])}{end()}", lambda: f"{P()} <{E()}> {c(['wrote', 'schrieb', 'a écrit', 'escribió'])}:",
            lambda: f"{c(['He', 'She', 'The tenant', 'Our office', 'The family', 'The shop', 'I', 'The firm'])} {c(['moved to', 'lives at', 'is at', 'is located at', 'sits at', 'left', 'bought', 'was seen at', 'moved from ' + A() + ' to'])} {A()}{when()}{end()}", lambda: f"{who()} {c(['moved', 'drove', 'cycled', 'walked', 'commutes'])} from {A()} to {A()}{when()}{end()}", lambda: f"{who()} {c(['moved to', 'lives at', 'rents', 'sold'])} {A()}{when()}{end()}", lambda: f"{c(['Deliver', 'Ship', 'Send', 'Mail', 'Post'])} {c(['it', 'the ' + noun(), 'everything', 'a copy'])} to {c([A, lambda: f'{P()}, {A()}'])()}{when()}{end()}", lambda: f"The {c(['parcel', 'letter', 'card', 'form', 'invoice', 'lease', 'map'])} {c(['lists', 'names', 'shows', 'was left at', 'went to', 'gives'])} {A()}{c(['', ' on its back', ' and ' + T()])}{end()}", lambda: f"{c(['Visit us at', 'Meet at', 'Our address:', 'Find us at', 'Return to', 'The house at', 'Office:'])} {A()}{end()}", lambda: f"{c([P, who])()}, {A()}{c(['', ', ' + T(), ', ' + E(), ', before ' + c(_TEXT['day'])])}{end()}",
            lambda: f"{c(['My', 'Her', 'His', 'The', 'Your', 'Their'])} {ident(1)}{end()}", lambda: f"{ident()} {c(['belongs to', 'was issued to', 'is that of', 'was given by'])} {P()}{end()}", lambda: f"{P()}{c([', ', ' / ', ' (', ' – ', '; ', ' | '])}{ident()}{c(['', ' / ' + T(), '.', ', ' + A()])}", lambda: f"{c(['The scan has', 'Number on the card:', 'ID given:', 'It says', 'He typed', 'The card reads', 'We have', 'Identity checked:', 'The identity number is', 'Verified with', 'Please enter'])} {c([ident, num_only])()}{c(['', ' for ' + P(), ' and ' + P()])}{end()}", lambda: f"{c(['Passport', 'The passport', 'A passport'])} {num_only()} {c(['expires in', 'was issued in', 'is valid until'])} {self._n(2020, 2035)}.",
            lambda: any_field(), lambda: any_field(), lambda: c(["\n", "\n", "; ", ", ", " | "]).join(any_field() for _ in range(self.r.randint(2, 5))), lambda: c([" / ", ";", "\t", ", ", " | ", " - "]).join(one() for _ in range(self.r.randint(2, 4))), lambda: f"{c(['Record', 'Entry', 'Row', 'Tenant', 'Client', 'Guest', 'Applicant', 'Member'])}{c([': ', ' ' + self._n(1, 999) + ': '])}{P()}{c([' / ', ', ', '; '])}{one()}{c(['', ' / ' + one()])}", lambda: f'{{"name": "{P()}", "{c(["mail", "phone", "address"])}": "{c([E, T, A])()}"}}', lambda: f"{c(['Signed by', 'Approved by', 'Seen by', 'Owner:', 'Author:', 'Assigned to', 'Reviewed by', 'Written by', 'Signed,', 'Present:', 'Paid by'])} {c([P, who])()}{c(['', ', ' + ident(), ' ' + reach(), ', ' + T(), '.'])}",
            lambda: f"{c(['Im Vorstand sitzt', 'Der Antrag kam von', 'Wir danken', 'Zuständig ist', 'Fragen beantwortet', 'Der Brief ging an', 'Bitte informieren Sie', 'Der Schlüssel liegt bei'])} {c([P, lambda: f'Frau {F()}', lambda: f'Herr {F()}', P])()}{c(['.', f', Telefon {T()}.', f', {A()}.', f', Tel. {T()}, E-Mail {E()}.', f' ({E()}).'])}", lambda: f"{c(['Bitte rufen Sie', 'Rückruf erbeten unter', 'Sie erreichen uns unter', 'Telefon', 'Handy'])} {T()}{c([' an', '', ' oder ' + E()])}.", lambda: f"{c(['Herr', 'Frau', 'Familie', 'Dr.'])} {F()} {c(['wohnt in der', 'wohnt', 'zog um nach', 'Anschrift'])} {A()}.", lambda: f"{c(['Die Adresse lautet', 'Unsere Anschrift:', 'Lieferung an', 'Wohnhaft'])} {A()}.", lambda: f"{P()} {c(['hat angerufen', 'ist krank', 'unterschrieb den Vertrag', 'bestätigt die Lieferung', 'zieht um'])}.",
            lambda: f"{c(['Veuillez contacter', 'Il faut rappeler', 'Le dossier de', 'Bonjour', 'La demande vient de', 'Adressez-vous à', 'La lettre de', 'Prière d’informer'])} {c([P, lambda: f'M. {F()}', lambda: f'Mme {F()}', P])()}{c(['.', f' au {T()}.', f' ({E()}).', f', {A()}.', f', joignable au {T()}.'])}", lambda: f"{c(['M.', 'Mme', 'Madame', 'Monsieur'])} {c([F, P])()} {c(['habite', 'habite au', 'demeure', 'réside au'])} {A()}.", lambda: f"{c(['Appelez le', 'Téléphone :', 'Joignable au', 'Écrivez à'])} {c([T, E])()}.", lambda: f"{P()} {c(['a appelé', 'a signé le contrat', 'est absente', 'confirme la livraison'])}.",
            lambda: f"{c(['Llame a', 'Pregunte por', 'El señor', 'La señora', 'Escriba a', 'La carta es de', 'Firmado por', 'El contrato de'])} {P()}{c(['.', f', {A()}.', f', teléfono {T()}.', f', correo {E()}.', f' al {T()}.'])}", lambda: f"{c(['La abogada', 'El médico', 'La profesora', 'El alcalde', 'La directora', 'Mi vecina', 'Mi hermano'])} {P()} {c(['tiene', 'perdió', 'abrió', 'vendió', 'busca'])} {c(['su casa', 'la llave', 'el libro', 'una tienda'])}{c(['', ' en la ' + A(), ' en ' + self.town()])}.", lambda: f"{c(['L’avocate', 'Le médecin', 'La directrice', 'Le maire', 'Ma voisine', 'Mon frère', 'L’élève'])} {P()} {c(['cherche', 'a perdu', 'vend', 'ouvre', 'a fermé'])} {c(['sa maison', 'la clé', 'un livre', 'la boutique'])}{c(['', ' au ' + A(), ' à ' + self.town()])}.", lambda: f"{c(['Der Lehrer', 'Die Ärztin', 'Der Bürgermeister', 'Die Anwältin', 'Mein Nachbar', 'Meine Schwester', 'Die Leiterin'])} {P()} {c(['sucht', 'verlor', 'verkauft', 'öffnet', 'braucht', 'hat'])} {c(['ihr Haus', 'den Schlüssel', 'ein Buch', 'die Werkstatt'])}{c(['', ' in der ' + A(), ' in ' + self.town()])}.", lambda: f"{P()} {c(['sucht', 'verlor', 'liest', 'kauft', 'kennt', 'hilft', 'wartet seit'])} {c(['ihr Haus', 'den Schlüssel', 'ein Buch', 'dem Nachbarn', 'Montag'])}.",
            lambda: f"{c(['Mi dirección es', 'Vive en', 'Enviar a', 'La oficina está en'])} {A()}.", lambda: f"{c(['Mi teléfono es', 'Llame al', 'Mi correo es'])} {c([T, E])()}.", lambda: f"{P()} {c(['llamó ayer', 'firmó el contrato', 'vive aquí', 'confirmó la entrega'])}.",
        ])()

    def text(self) -> str:
        """A sentence with or without mentions, alone or among others."""
        if self._p(0.4):
            return " ".join(self.plain() for _ in range(self.r.randint(1, 2)))
        parts = [self.marked()]
        if self._p(0.35):
            parts.insert(0, self.plain())
        if self._p(0.4):
            parts.append(self.plain() if self._p(0.7) else self.marked())
        return self._c([" ", " ", " ", "\n"]).join(parts) + (self._c([" 🙂", " ✅", " 🎉"]) if self._p(0.03) else "")


def sentences(count: int = 15_000, seed: int = 20) -> tuple[list[str], dict[str, set[str]]]:
    """The labelled sentences and the staff list that goes with them, the same in every run."""
    g = Grammar(seed)
    return [g.text() for _ in range(count)], g.listed


_MARK = re.compile(r"\[(%s)\|" % "|".join(KINDS))


def parse(marked: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The plain text of a marked sentence and its mentions (start, end, kind)."""
    plain, spans, at = "", [], 0
    for m in _MARK.finditer(marked):
        plain += marked[at : m.start()]
        end = marked.index("]", m.end())
        inner = marked[m.end() : end].replace("⟦", "[").replace("⟧", "]")
        spans.append((len(plain), len(plain) + len(inner), m.group(1)))
        plain += inner
        at = end + 1
    return plain + marked[at:], spans
