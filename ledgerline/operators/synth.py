"""Synthetic entries whose every draw is a hash of seed, row and draw: the same however rows are dealt out.

The generator is text of SQL that several engines read alike: stages, each of which adds columns made from those of
the stages before; the first makes an array of the row's draws.  Where engines differ (arrays, numbers from hashes,
regular expressions), an ``Engine`` spells it.  So no stage's expression gets large, and any engine can run the same
stages to check another.

Rates, publishers' years, weights of residence marks and the printed forms are fixed values, as texts that are to be like
others have to have them.  The pools of names, streets, trades and firms are our own, of common ones by alphabet; pools of
weighted terms (``pools.tempered``, ``pools.blended``) can be given instead for surnames and occupations.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FIELDS
from . import pools

# ---------------------------------------------------------------- our own pools

MEN = "Albert Alfred Andrew Anton August Benjamin Bernard Charles Christian Daniel David Dennis Edward Ernest Eugene Francis Frederick George Henry Herman Hugh Isaac Jacob James Jeremiah John Joseph Lawrence Louis Martin Matthew Michael Nathan Nicholas Oscar Otto Owen Patrick Peter Philip Richard Robert Samuel Simon Stephen Theodore Thomas Timothy Walter William".split()
WOMEN = "Adelaide Agnes Alice Amelia Ann Augusta Barbara Bertha Bridget Caroline Catherine Cecilia Clara Cornelia Delia Eleanor Eliza Ellen Emily Esther Eva Frances Harriet Helen Ida Isabella Jane Josephine Julia Louisa Lucy Margaret Maria Martha Mary Matilda Minnie Rachel Rebecca Rosa Ruth Sarah Sophia Susan Theresa".split()
RARE_MEN = "Abijah Ambrose Archelaus Barnabas Cephas Cyrenus Darius Ebenezer Eleazer Gamaliel Hosea Ichabod Jotham Lemuel Melchior Obadiah Phineas Silvanus Thaddeus Uriah Zebulon".split()
RARE_WOMEN = "Abigail Althea Araminta Clarinda Damaris Dorothea Euphemia Evelina Hagar Jemima Keturah Leonora Lucretia Marietta Naomi Ottilie Priscilla Rosetta Selina Thirza Ursula".split()
SHORT = {"Albert": "Albt", "Andrew": "Andw", "Benjamin": "Benj", "Charles": "Chas", "Christian": "Chris", "Daniel": "Danl", "Edward": "Edw", "Frederick": "Fredk", "George": "Geo", "James": "Jas", "John": "Jno", "Joseph": "Jos", "Nathan": "Nathl", "Richard": "Richd", "Robert": "Robt", "Samuel": "Saml", "Theodore": "Theo", "Thomas": "Thos", "William": "Wm", "Catherine": "Cath", "Margaret": "Margt", "Elizabeth": "Eliz"}
CONTRACTED = {"Edward": "Edw^d", "Richard": "Rich^d", "Robert": "Rob^t", "Samuel": "Sam^l"}  # ^ stands for an apostrophe
SURNAMES = "Ackerman Adams Bauer Becker Bennett Brennan Byrne Callahan Carpenter Clancy Conklin Crane Curran Daly Decker Dolan Donnelly Dougherty Egan Engel Farley Fay Fink Flanagan Foster Gallagher Geiger Gibson Gorman Haas Hamilton Hart Healy Heinrich Hogan Horton Jackson Jacobs Keenan Keller Kirby Klein Koch Lang Levy Lockwood Mahoney Mandel Mead Meyer Mooney Mulligan Nolan Odell Parker Peck Quinn Reilly Richter Roth Sauer Seaman Shea Stein Sutton Tighe Tracy Underhill Vogel Wagner Weiss Whelan Young Zimmer".split()
#: Trades and how often; what women were listed with.
TRADES = [("clerk", 28), ("laborer", 25), ("carpenter", 11), ("tailor", 8), ("driver", 7), ("grocer", 7), ("mason", 6), ("painter", 6), ("shoemaker", 6), ("porter", 5), ("baker", 4), ("butcher", 4), ("machinist", 4), ("peddler", 4), ("printer", 4), ("sailor", 3), ("barber", 3), ("bookkeeper", 3), ("cooper", 3), ("hatter", 2), ("janitor", 2), ("jeweler", 2), ("merchant", 2), ("plumber", 2), ("waiter", 2), ("watchman", 2), ("weaver", 2), ("broker", 1), ("engineer", 1), ("importer", 1), ("lawyer", 1), ("physician", 1), ("stationer", 1)]
WOMENS_TRADES = ["boardinghouse", "cloakmaker", "corsets", "dressmaker", "embroiderer", "furnished rooms", "glovemaker", "governess", "hairdresser", "lacemaker", "matron"]
SHORT_TRADES = {"clerk": "cl", "laborer": "labr", "carpenter": "carpr.", "machinist": "machst", "merchant": "merchnt", "bookkeeper": "bookpr", "engineer": "engr", "watchman": "wtchmn", "importer": "impr.", "shoemaker": "shoemkr", "dressmaker": "drsmkr.", "plumber": "plumbr", "stationer": "statnr"}
FIRM_TRADES = ["bakers", "brokers", "chemists", "hats", "ironware", "provisions"]
GOODS = ["baskets", "books", "brushes", "carpets", "china", "cigars", "clocks", "feed", "fruit", "glass", "hay", "lamps", "lumber", "seeds", "silks", "stoves", "teas", "toys"]
GOODS_TAIL = ["agency", "depot", "shop", "warehouse"]
MADE = ["bell", "box", "brush", "candle", "comb", "glove", "harness", "lamp", "saddle", "sail", "spoon", "umbrella"]
SECOND_TRADES = ["agent", "bookseller", "conveyancer", "interpreter", "sign painter", "valuer"]
CHURCH_POSTS, POSTS = ["beadle", "chorister", "sexton", "warden"], ["assessor", "comptroller", "register", "superintendent"]
POST_OF = ["bridges", "buildings", "coal", "ferries", "grain", "sewers", "streets", "the harbor"]
CHURCHES = ["2d Reformed Church", "All Saints Church", "Calvary Chapel", "Christ Church", "Grace Church", "St Lukes Church", "St Marys Chapel", "Zion Church"]
WORKS = ["Battery baths", "City Hall", "brewery", "cotton mill", "dry dock", "ferry house", "powder mill", "print works", "sail loft", "tannery"]
LATE_FIRMS = ["Atlas Ins Co", "Borough Bank", "City Ry Co", "Dept of Parks", "Empire Tel Co", "Gen Ship Co", "Harbor Ex Co", "Home Trust Co", "Metro Gas Co", "Natl Paper Co", "Union Ice Co"]
LATE_POSTS = ["acct", "adjuster", "asst cashr", "auditor", "buyer", "cashr", "chemist", "draftsman", "paymaster", "teller"]
MID_POSTS = ["foreman", "overseer", "storekpr", "timekpr"]
STREETS = ["Bank", "Bayard", "Beach", "Bond", "Broome", "Carmine", "Charles", "Christopher", "Columbia", "Crosby", "Eldridge", "Elizabeth", "Elm", "Ferry", "Great Jones", "Grove", "Horatio", "Howard", "Jane", "Jay", "Laight", "Lewis", "Mercer", "Morton", "Oliver", "Perry", "Pitt", "Ridge", "Sheriff", "Stone", "Sullivan", "Thompson", "Vandam", "Varick", "West", "Wooster"]
LATE_STREETS = ["Audubon av", "Bradhurst av", "Bryant av", "Claremont av", "Edgecombe av", "Gramercy pk", "Hamilton pl", "Haven av", "Hoe av", "Jerome av", "Lenox av", "Manhattan av", "Morris av", "Mt Morris pk", "Ogden av", "Sedgwick av", "Southern blvd", "St Nicholas av"]
EARLY_STREETS = ["Anthony", "Barley", "Church", "Fletcher", "Garden", "Gold", "Harman", "Little Dock", "Lombard", "Lumber", "Moore", "Partition", "Princess", "Rose", "Rutgers", "Stone", "Vesey", "Whitehall"]
SHORT_STREETS = {"Anthony": "Anth.", "Church": "Chur.", "Fletcher": "Fletch.", "Garden": "Gard.", "Harman": "Harm.", "Lombard": "Lomb.", "Partition": "Part.", "Princess": "Princ.", "Whitehall": "Whiteh."}
QUARTERS = ["Astoria", "Bayside", "Bushwick", "Elmhurst", "Flatlands", "Gravesend", "Jackson Hts", "Kew Gdns", "LIC", "Richmond Hill", "Ridgewd", "Stapleton"]
OUT_OF_TOWN = ["Bayonne N J", "Bridgeport Conn", "Dobbs Ferry", "Englewood N J", "Great Neck", "New Rochelle", "Orange N J", "Passaic N J", "Peekskill N Y", "Rye", "Summit N J"]
TOWN_STREETS = ["Adams", "Aspen", "Buena Vista", "Cedar", "Columbus", "Delaware", "Evergreen", "First Natl", "Hickory", "Jefferson", "Lincoln", "Magnolia", "Nogales", "Osage", "Osceola", "Phoenix", "Rockford", "Spruce", "Victor", "Wheeling"]
TOWN_QUARTER = ["Apache", "Jasper", "Lansing", "Oklahoma", "Pine", "Queen", "Tecumseh", "Virgin"]
TOWN_BUILDINGS, TOWN_HOTELS, SUBURBS = ["Alexander Bldg", "Central Bldg", "Iowa Bldg", "Palace Bldg", "Robinson Bldg"], ["Brady Hotel", "Hotel Lee", "Oxford Hotel", "Terminal Hotel"], ["Alsuma", "Broken Arrow", "Carbondale", "Jenks", "Sapulpa rd"]
TOWN_TRADES = [("clerk", 26), ("laborer", 22), ("carpenter", 11), ("salesman", 10), ("mechanic", 9), ("stenog", 9), ("bookpr", 7), ("teacher", 6), ("auto mech", 5), ("oil worker", 5), ("trucker", 5), ("fireman", 4), ("painter", 4), ("barber", 3), ("contractor", 3), ("grocer", 3), ("dentist", 2), ("lawyer", 2), ("physician", 2)]
EMPLOYED = ["clerk", "laborer", "salesman", "mechanic", "stenog", "bookpr", "teacher", "auto mech", "oil worker", "trucker", "fireman"]
SERVICE_TRADES = ["bellboy", "bootblack", "dishwasher", "elevator opr", "houseman", "ironer", "laundress", "pantryman", "yardman"]
TOWN_FIRMS = ["Central High School", "City Water Wks", "Exchange Oil Co", "Kendall College", "Midland Ry", "Natl Supply Co", "Oklahoma Nat Gas Co", "Palace Clothiers", "Street Ry Co", "Tulsa World"]
TOWN_LINES = ["attorneys", "bakery", "drugs", "furniture", "grocers", "hardware", "laundry", "oil producers", "plumbers", "real est"]
TOWN_SUFFIXES, TOWN_WORDS, TOWN_TAILS = ["& CO", "& SON", "& SONS", "BROS", "STORES"], ["BAKING", "CANDY", "COAL", "LUMBER", "SHOE"], ["& Bro", "Hdw Co", "Lumber Co", "Supply Co"]

# ---------------------------------------------------------------- fixed values

INITIALS = list("ABCDEFGHJLMRSTW")
PREFIXES = [("r", 39), ("b", 20), ("rms", 18), ("", 13), ("h", 4), ("rear", 3)]
REAR_PREFIXES = [("r", 39), ("b", 20), ("rms", 18), ("", 13), ("h", 4), ("rear", 12)]
#: Up to a year, its publishers with weight and, where that is part of the span, first and last year.
PUBLISHERS = [
    (1787, [("franks", 1)]), (1796, [("duncan", 1)]), (1817, [("longworth", 1)]),
    (1841, [("longworth", 6), ("mercein", 2, 1818, 1826), ("ogden", 5, 1838)]), (1851, [("doggett", 7), ("rode", 3, 1850)]),
    (1861, [("trow", 6), ("hearne", 2, 0, 1855), ("hopehenderson", 2, 1855), ("smith", 1)]), (1897, [("trow", 6), ("lain", 3), ("boyd", 1, 1885, 1895)]),
    (1914, [("trow", 8), ("upington", 2)]), (1930, [("polk", 8), ("trow", 2, 0, 1922)]), (9999, [("polk", 7), ("mb", 3)]),
]
#: Rates in the early, mid and late era.
RARE, SHORTENED, COMPOUND, TRADE_SHORTENED, COMMA, CAPITALS, DITTO = (.12, .08, .05), (.15, .25, .35), (.10, .08, .03), (.35, .30, .45), (.5, .15, .04), (.02, .03, .01), (0, .05, .14)
HOME_MARKS, FUSED_MARKS = [("h", 40), ("h.", 28), ("b", 12), ("r", 8), ("bds", 12)], [("h", 75), ("r", 18), ("H", 7)]
SOLE_MARKS, DENSE_MARKS = [("h", 55), ("h.", 15), ("bds", 15), ("r", 8), ("b", 7)], [("h", 55), ("r", 25), ("H", 8), ("b", 5), ("bds", 7)]
RACE = [("col^d", 4), ("colored", 2), ("col", 2), ("(co^d)", 2)]
SUFFIXES, WOMENS_TITLES, MENS_TITLES = ["jr", "jr.", "Jr", "jun.", "sen.", "senr."], ["Mrs", "Miss"], ["Rev", "Dr", "Capt"]
#: What stands before a late husband's name, by era.
WIDOWS = {"early": [("widow of ", 5), ("widow ", 2), ("wid. ", 2), ("w. of ", 1)], "mid": [("wid ", 4), ("wid. ", 3), ("widow of ", 2), ("widow ", 1)], "late": [("wid ", 5), ("wid. ", 4), ("Wid. ", 1)]}
STREET_KINDS = [("st", 30), ("", 40), ("av", 14), ("lane", 5), ("pl", 4), ("slip", 3), ("sq", 2), ("ter", 2)]
TOWN_KINDS = [("av", 60), ("", 28), ("boul", 4), ("pl", 4), ("ter", 2), ("ct", 2)]
#: Confusions of reading machines.
CONFUSIONS = [("m", "rn"), ("rn", "m"), ("l", "1"), ("1", "l"), ("O", "0"), ("0", "O"), ("S", "5"), ("B", "8"), ("cl", "d"), ("ii", "n"), ("u", "ii")]


class Draws:
    """Uniform numbers in [0, 1) as columns, each by a name of its own."""

    def __init__(self, seed: int, row: Column):
        self.seed, self.row = seed, row

    def u(self, name: str) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(self.seed), self.row.cast("string"), F.lit(name)).cast("binary"))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0

    def integer(self, name: str, lo: int, hi: int | Column) -> Column:
        return (F.floor(self.u(name) * (hi - lo + 1)) + lo).cast("int")

    def weighted(self, name: str, pairs: list[tuple[str, float]]) -> Column:
        total, upto, out, u = sum(w for _, w in pairs), 0.0, None, self.u(name)
        for value, w in pairs[:-1]:
            upto += w
            out = F.when(u < upto / total, value) if out is None else out.when(u < upto / total, value)
        return out.otherwise(pairs[-1][0]) if out is not None else F.lit(pairs[0][0])


def text(value: str) -> str:
    """A text in SQL; ``^`` stands for an apostrophe."""
    return "'" + value.replace("^", "' || chr(39) || '") + "'" if "^" in value else f"'{value}'"


class Engine(NamedTuple):
    """How an engine spells an array of n draws from a key that holds k, an array's item, and a regular expression's test."""

    draws: str = "transform(sequence(1, {n}), k -> cast(conv(substr(md5({key}), 1, 8), 16, 10) as double) / 4294967296e0)"
    item: str = "get({x}, {k} - 1)"
    like: str = "rlike({x}, r'{pattern}')"


SPARK = Engine()


class Rolls:
    """Draws of a row as SQL text: hashes of the seed, row_id, the part of the generator, and the draw's number in it."""

    def __init__(self, part: str, seed: int, engine: Engine = SPARK):
        self.part, self.seed, self.engine, self.names = part, seed, engine, {}

    def stage(self) -> dict[str, str]:
        """The array of all draws that were asked for."""
        key = f"'{self.seed}:' || cast(row_id as string) || ':{self.part}:' || cast(k as string)"
        return {f"{self.part}_draws": self.engine.draws.format(n=len(self.names), key=key)}

    def u(self, name: str) -> str:
        return self.engine.item.format(x=f"{self.part}_draws", k=self.names.setdefault(name, len(self.names) + 1))

    def below(self, name: str, p: float | str) -> str:
        return f"({self.u(name)} < {p if isinstance(p, str) else f'{p}e0'})"

    def number(self, name: str, lo: int, hi: int | str) -> str:
        many = f"{hi - lo + 1}" if isinstance(hi, int) else f"({hi} - {lo - 1})"
        return f"(cast(floor({self.u(name)} * {many}) as int) + {lo})"

    def pick(self, name: str, values: Iterable[str]) -> str:
        """One of texts that are equally likely."""
        values = list(values)
        return f"split_part('{'|'.join(values)}', '|', cast(floor({self.u(name)} * {len(values)}) as int) + 1)"

    def weighted(self, name: str, pairs: list[tuple[str, float]]) -> str:
        total, upto, parts = sum(w for _, w in pairs), 0.0, []
        for value, w in pairs[:-1]:
            upto += w
            parts.append(f"WHEN {self.u(name)} < {upto}e0 / {total} THEN {text(value)}")
        return f"CASE {' '.join(parts)} ELSE {text(pairs[-1][0])} END"

    def like(self, column: str, pattern: str) -> str:
        return self.engine.like.format(x=column, pattern=pattern)


def ordinal(n: str) -> str:
    """1st 2d 3d 4th, 11th 12th 13th."""
    return f"(cast({n} as string) || CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 IN (2, 3) THEN 'd' ELSE 'th' END)"


def joined(sep: str, *parts: str) -> str:
    """Parts that aren't empty."""
    return f"concat_ws('{sep}', {', '.join(f'''nullif({p}, '')''' for p in parts)})"


def mapped(column: str, table: dict[str, str]) -> str:
    """What the table has for a value, or null."""
    return f"CASE {column} {' '.join(f'WHEN {text(k)} THEN {text(v)}' for k, v in table.items())} END"


def by_era(rates: tuple[float, float, float]) -> str:
    early, mid, late = rates
    return f"(CASE era WHEN 'early' THEN {early}e0 WHEN 'mid' THEN {mid}e0 ELSE {late}e0 END)"


def one_of(column: str, values: Iterable[str]) -> str:
    return f"{column} IN ({', '.join(text(v) for v in values)})"


Stage = dict[str, str]
#: Stages whose code is generated as one.
SPAN = 4


def _publisher(r: Rolls) -> str:
    spans = []
    for upto, options in PUBLISHERS:
        weights = []
        for name, w, *years in options:
            first, last = (years + [0, 9999])[:2] if len(years) != 1 else (years[0], 9999)
            weights.append((name, str(w) if (first, last) == (0, 9999) else f"CASE WHEN year BETWEEN {first} AND {last} THEN {w} ELSE 0 END"))
        total = " + ".join(f"({w})" for _, w in weights)
        parts = [f"WHEN {r.u('publisher')} * ({total}) < {' + '.join(f'({w})' for _, w in weights[: k + 1])} THEN '{name}'" for k, (name, _) in enumerate(weights[:-1])]
        choice = f"CASE {' '.join(parts)} ELSE '{weights[-1][0]}' END" if parts else f"'{weights[0][0]}'"
        # The last of a span's publishers may have no weight in some of its years.
        if parts and weights[-1][1].startswith("CASE"):
            choice = f"CASE {' '.join(parts)} WHEN {weights[-1][1]} > 0 THEN '{weights[-1][0]}' ELSE '{weights[0][0]}' END"
        spans.append(f"WHEN year <= {upto} THEN {choice}")
    return f"CASE {' '.join(spans)} END"


def _given(r: Rolls, p: str, female: str, city: bool, short: float = 0.25) -> list[Stage]:
    """Column p: a given name."""
    first = {f"{p}_plain": f"CASE WHEN {female} THEN {r.pick(f'{p}_w', WOMEN)} ELSE {r.pick(f'{p}_m', MEN)} END"}
    rare = f"CASE WHEN {female} THEN {r.pick(f'{p}_rw', RARE_WOMEN)} ELSE {r.pick(f'{p}_rm', RARE_MEN)} END"
    plain = f"{p}_plain"
    if city:
        contracted = f"WHEN era = 'late' AND {r.below(f'{p}_contract', 0.12)} AND {one_of(plain, CONTRACTED)} THEN {mapped(plain, CONTRACTED)}"
        stop = f"|| CASE WHEN {r.below(f'{p}_stop', 0.35)} THEN '.' ELSE '' END"
        rate, chance = by_era(RARE), by_era(SHORTENED)
    else:
        contracted, stop, rate, chance = "", "", "0.05e0", f"{short}e0"
    shortened = f"WHEN {r.below(f'{p}_short', chance)} AND {one_of(plain, SHORT)} THEN {mapped(plain, SHORT)} {stop}" if short else ""
    return [first, {p: f"CASE WHEN {r.below(f'{p}_rare', rate)} THEN {rare} {contracted} {shortened} ELSE {plain} END"}]


def _initial(r: Rolls, name: str, p: float, stop: float = 0) -> str:
    tail = f" || CASE WHEN {r.below(f'{name}_stop', stop)} THEN '.' ELSE '' END" if stop else ""
    return f"CASE WHEN {r.below(f'{name}_is', p)} THEN {r.pick(f'{name}_which', INITIALS)}{tail} ELSE '' END"


# ---------------------------------------------------------------- the large city


def _city_street(r: Rolls, p: str) -> list[Stage]:
    """Columns p: a street of any time, and p_early, p_late."""
    roll = r.u(f"{p}_kind")
    kind = r.weighted(f"{p}_type", STREET_KINDS)
    return [
        {f"{p}_n": r.number(f"{p}_no", 1, 50), f"{p}_av": r.number(f"{p}_avno", 1, 12), f"{p}_far": r.number(f"{p}_farno", 1, 180), f"{p}_type": f"CASE WHEN {kind} = 'av' AND {r.below(f'{p}_avy', 0.3)} THEN 'Avy.' ELSE {kind} END"},
        {
            p: f"CASE WHEN {roll} < 0.096e0 THEN {ordinal(f'{p}_av')} || ' av' WHEN {roll} < 0.16e0 THEN 'av ' || {r.pick(f'{p}_letter', 'ABCD')} WHEN {roll} < 0.34e0 THEN {ordinal(f'{p}_n')} || ' st' ELSE {joined(' ', r.pick(f'{p}_name', STREETS), f'{p}_type')} END",
            f"{p}_early": r.pick(f"{p}_early", EARLY_STREETS),
            f"{p}_late": f"CASE WHEN {roll} < 0.42e0 THEN {r.pick(f'{p}_side', 'WE')} || CASE WHEN {r.below(f'{p}_fused', 0.75)} THEN '' ELSE ' ' END || {ordinal(f'{p}_far')} WHEN {roll} < 0.5e0 THEN CASE WHEN {r.below(f'{p}_lettered', 0.4)} THEN 'Av ' || {r.pick(f'{p}_avletter', 'ABCD')} ELSE {ordinal(f'{p}_av')} || ' av' END ELSE {r.pick(f'{p}_lname', LATE_STREETS)} END",
        },
    ]


def _city_address(r: Rolls, p: str, home: bool) -> list[Stage]:
    """Column p: an address as the volume's time prints it."""
    s, n = f"{p}_street", f"cast({p}_no as string)"
    other = lambda k: r.pick(f"{p}_other{k}", STREETS)
    do = "(CASE WHEN publisher = 'duncan' THEN 0.45e0 ELSE 0.10e0 END)"
    roll, early = f"{p}_roll", f"{p}_eroll"
    stop = lambda k: f"CASE WHEN {r.below(f'{p}_stop{k}', 0.30)} THEN '.' ELSE '' END"
    hyphened = r.weighted(f"{p}_hyphen", [("-street", 5), ("-st", 2), ("-st.", 2), ("-lane", 1)])
    named = f"coalesce({mapped(f'{s}_early', SHORT_STREETS)}, substr({s}_early, 1, 3) || '.')"
    tail = r.weighted(f"{p}_form", [(" street", 4), ("st.", 3), (" st.", 2)])
    quarter = r.pick(f"{p}_quarter", QUARTERS)
    outer = "(CASE WHEN publisher = 'polk' AND year >= 1931 THEN 0.65e0 ELSE 0.24e0 END)"
    if home:
        rooms = f"CASE WHEN {r.below(f'{p}_apt', 0.06)} THEN ' apt ' || cast({r.number(f'{p}_aptno', 1, 40)} as string) || {r.pick(f'{p}_aptl', 'ABCDEFGH')} ELSE '' END"
    else:
        room = r.u(f"{p}_room")
        rooms = f"CASE WHEN {room} < 0.09e0 THEN ' R' || cast({r.number(f'{p}_r1', 1, 1400)} as string) WHEN {room} < 0.115e0 THEN ' R ' || cast({r.number(f'{p}_r2', 1, 40)} as string) WHEN {room} < 0.135e0 THEN ' ' || cast({r.number(f'{p}_r3', 2, 1400)} as string) ELSE '' END || CASE WHEN {r.below(f'{p}_bkn', 0.04)} THEN ' Bkn' ELSE '' END"
    return [
        *_city_street(r, s),
        {roll: r.u(f"{p}_roll"), early: r.u(f"{p}_eroll"), f"{p}_no": r.number(f"{p}_no", 1, 600), f"{p}_far": r.number(f"{p}_far", 1, 3600), f"{p}_ord": r.number(f"{p}_ord", 1, 180)},
        {
            f"{p}_dense": f"cast({p}_far as string) || CASE WHEN {r.like(f'{s}_late', '^[0-9]')} AND {r.below(f'{p}_mark', 0.22)} THEN ',' ELSE '' END || ' ' || {s}_late || {rooms}",
            f"{p}_old": f"CASE WHEN {early} < {do} THEN CASE WHEN {r.below(f'{p}_bare', 0.8)} THEN {n} || ' ' ELSE '' END || {s}_early || ' do.' WHEN {early} < {do} + 0.16e0 THEN {n} || ' ' || {s}_early || {hyphened} || CASE WHEN {hyphened} = '-st.' THEN '' ELSE {stop(1)} END WHEN {early} < {do} + 0.28e0 THEN {n} || ' ' || {named} || {tail} ELSE {n} || ' ' || {s} || {stop(2)} END",
            f"{p}_outer": f"CASE WHEN {r.below(f'{p}_outer', outer)} THEN {n} || '-' || cast({r.number(f'{p}_sub', 1, 64)} as string) || ' ' || CASE WHEN {r.below(f'{p}_bareord', 0.55)} THEN {ordinal(f'{p}_ord')} || CASE WHEN {r.below(f'{p}_ordav', 0.45)} THEN ' av' ELSE '' END ELSE {s} END || CASE WHEN {r.below(f'{p}_q1', 0.75)} THEN ' ' || {quarter} ELSE '' END ELSE {n} || ' ' || {s} || CASE WHEN {r.below(f'{p}_q2', 0.25)} THEN ' ' || {quarter} ELSE '' END END",
        },
        {
            p: f"CASE WHEN print_dense AND {roll} < 0.88e0 THEN {p}_dense WHEN {roll} < 0.05e0 THEN {r.pick(f'{p}_rear', ['rear', 'ft'])} || ' ' || {n} || ' ' || {s} WHEN {roll} < 0.08e0 THEN CASE WHEN era = 'early' AND {r.below(f'{p}_spelt', 0.5)} THEN 'corner of' ELSE {r.pick(f'{p}_cor', ['cor', 'c'])} END || ' ' || {other(1)} || ' and ' || {other(2)} WHEN {roll} < 0.10e0 THEN {r.pick(f'{p}_nr', ['nr', 'n'])} || ' ' || {other(1)} WHEN {roll} < 0.115e0 THEN 'bet ' || {other(1)} || ' and ' || {other(2)} WHEN {roll} < 0.15e0 THEN {other(1)} || ' ' || {r.pick(f'{p}_rel', ['c', 'n'])} || ' ' || {other(2)} WHEN era = 'early' THEN {p}_old WHEN era = 'late' AND year >= 1915 THEN {p}_outer ELSE {n} || ' ' || {s} END",
        },
    ]


def _city_trade(r: Rolls) -> list[Stage]:
    """Columns trade, trade_firm and trade_of: a plain trade reshaped as its time prints it."""
    sub = "trade_sub"
    two = lambda name, values: (r.pick(f"{name}1", values), r.pick(f"{name}2", values))

    def different(name, values):
        """Two values that differ: the second is so many places after the first."""
        n = len(values)
        first = f"cast(floor({r.u(f'{name}1')} * {n}) as int)"
        again = "|".join(values * 2)
        step = f"cast(floor({r.u(f'{name}2')} * {n - 1}) as int)"
        return f"split_part('{again}', '|', {first} + 1)", f"split_part('{again}', '|', {first} + {step} + 2)"

    goods, made, roles = different("goods", GOODS), different("made", MADE), different("roles", SECOND_TRADES)
    compound = f"CASE WHEN {sub} < 0.28e0 THEN {goods[0]} || ' & ' || {goods[1]} || CASE WHEN {r.below('goods_tail', 0.4)} THEN ' ' || {r.pick('goods_which', GOODS_TAIL)} ELSE '' END WHEN {sub} < 0.48e0 THEN {made[0]} || {r.pick('made_and', [' & ', ' and '])} || {made[1]} || CASE WHEN {r.below('made_tail', 0.5)} THEN '-maker' ELSE ' maker' END WHEN {sub} < 0.68e0 THEN {roles[0]} || ' & ' || {roles[1]} WHEN {sub} < 0.84e0 THEN {r.pick('church_post', CHURCH_POSTS)} ELSE {r.pick('post', POSTS)} || ' of ' || {r.pick('post_of', POST_OF)} END"
    return [
        {"plain": f"CASE WHEN {r.below('jobless', 0.15)} THEN '' WHEN female AND {r.below('womans', 0.75)} THEN {r.pick('womans_which', WOMENS_TRADES)} ELSE occupation END", sub: r.u("trade_sub")},
        {"compound": f"plain <> '' AND {r.below('compound', by_era(COMPOUND))}"},
        {
            "trade": f"CASE WHEN plain = '' THEN '' WHEN compound THEN {compound} WHEN {r.below('trade_short', by_era(TRADE_SHORTENED))} AND {one_of('plain', SHORT_TRADES)} THEN {mapped('plain', SHORT_TRADES)} WHEN {r.below('trade_stop', 0.04)} THEN plain || '.' ELSE plain END",
            "trade_firm": f"CASE WHEN compound AND {sub} >= 0.68e0 AND {sub} < 0.84e0 THEN {r.pick('church', CHURCHES)} ELSE '' END",
        },
    ]


def city_stages(seed: int, engine: Engine = SPARK) -> list[Stage]:
    """Entries of a large city's volumes over three eras: from row_id, surname, surname2 and occupation."""
    r = Rolls("city", seed, engine)
    h = r.pick("husband", MEN)
    marked = " ".join(f"WHEN era = '{e}' THEN {r.weighted(f'wid_{e}', pairs)}" for e, pairs in WIDOWS.items())
    era, firm = r.u("era"), r.u("firm")
    ditto_mark = f"CASE publisher WHEN 'polk' THEN '\" ' WHEN 'trow' THEN '-' ELSE CASE WHEN era = 'mid' OR {r.below('ditto_mark', 0.4)} THEN '-' ELSE '\" ' END END"
    ends = lambda x: r.like(x, f" ({'|'.join(QUARTERS)})$")
    quarter_comma = lambda x: f"CASE WHEN quarter_comma AND {ends(x)} THEN {' '.join(_cut_quarter(x))} ELSE {x} END"

    def _cut_quarter(x):
        longest = sorted(QUARTERS, key=lambda q: -len(q))
        cases = " ".join(f"WHEN {x} LIKE '% {q}' THEN substr({x}, 1, length({x}) - {len(q) + 1}) || ', {q}'" for q in longest)
        return [f"CASE {cases} ELSE {x} END"]

    stages = [
        {"era": f"CASE WHEN {era} < 0.18e0 THEN 'early' WHEN {era} < 0.68e0 THEN 'mid' ELSE 'late' END"},
        {"year": f"CASE era WHEN 'early' THEN {r.number('year_early', 1786, 1849)} WHEN 'mid' THEN {r.number('year_mid', 1850, 1890)} ELSE {r.number('year_late', 1891, 1933)} END"},
        {
            "directory_year": f"CASE WHEN era = 'mid' OR era = 'late' AND {r.below('slash', 0.4)} THEN cast(year as string) || '/' || lpad(cast((year + 1) % 100 as string), 2, '0') ELSE cast(year as string) END",
            "publisher": _publisher(r), "is_business": r.below("business", 0.03), "woman": r.below("female", 0.28),
        },
        {
            "dense": "publisher IN ('trow', 'polk') AND year >= 1905", "print_dense": "publisher IN ('trow', 'polk') AND year BETWEEN 1900 AND 1930 OR publisher = 'mb'",
            "female": "woman AND NOT is_business", "widow": f"woman AND NOT is_business AND {r.below('widow', 0.30)}", "ditto": f"NOT is_business AND {r.below('ditto', by_era(DITTO))}",
        },
        *_given(r, "given", "female", True), *_given(r, "own", "true", True), *_city_address(r, "primary_at", False), *_city_address(r, "home_at", True), *_city_trade(r),
        {
            "own_name": f"widow AND NOT ditto AND {r.below('own_name', 0.15)}",
            "star": f"NOT is_business AND (publisher = 'ogden' AND {r.below('star', 0.22)} OR publisher = 'hopehenderson' AND {r.below('star', 0.12)})",
            "race_rate": "CASE WHEN publisher = 'ogden' THEN 0e0 WHEN publisher = 'hopehenderson' THEN 0.012e0 WHEN era IN ('early', 'mid') AND year >= 1839 THEN 0.015e0 ELSE 0.004e0 END",
            "suffix": f"CASE WHEN NOT female AND {r.below('suffix', 0.035)} THEN {r.pick('suffix_which', SUFFIXES)} ELSE '' END",
            "principal": f"NOT is_business AND NOT widow AND trade_firm = '' AND dense AND {r.below('principal', 0.05)}",
        },
        {
            "race_designation": f"CASE WHEN is_business THEN '' WHEN publisher = 'ogden' THEN CASE WHEN star THEN '*' ELSE '' END WHEN star THEN '' WHEN {r.below('race', 'race_rate')} THEN CASE WHEN publisher = 'hopehenderson' THEN {text('col^d')} ELSE {r.weighted('race_which', RACE)} END ELSE '' END",
            "spouse_name": f"CASE WHEN NOT widow THEN '' WHEN own_name THEN {r.pick('bare', ['widow', 'wid.'])} ELSE CASE {marked} END || {h} END",
            "hired": f"NOT is_business AND NOT widow AND NOT principal AND trade_firm = '' AND trade <> '' AND (dense AND {r.below('hired', 0.20)} OR era = 'mid' AND NOT dense AND {r.below('hired', '''(CASE WHEN publisher = 'hearne' THEN 0.25e0 ELSE 0.04e0 END)''')})",
            "pastor": r.below("pastor", 0.30),
            "caps": f"NOT is_business AND NOT ditto AND {r.below('caps', by_era(CAPITALS))}",
            "firm_name": f"CASE WHEN era = 'late' AND {r.below('firm_ditto', 0.10)} THEN CASE publisher WHEN 'trow' THEN '-' ELSE '\" ' END || {r.pick('firm_a', INITIALS)} || ' ' || {r.pick('firm_b', INITIALS)} || ' & Co' ELSE CASE WHEN {firm} < 0.4e0 THEN surname || ' & ' || surname2 WHEN {firm} < 0.7e0 THEN surname || ' & Co' WHEN {firm} < 0.85e0 THEN surname || ' Bros' ELSE surname || ' & Son' END END",
        },
        {
            "person": f"CASE WHEN ditto THEN {ditto_mark} || {joined(' ', 'given', _initial(r, 'ditto_middle', 0.45))} WHEN own_name THEN surname || ' ' || own ELSE {joined(' ', 'surname', 'given', _initial(r, 'middle', 0.30, 0.35), 'suffix')} END",
            "employer": f"CASE WHEN is_business OR widow THEN '' WHEN trade_firm <> '' THEN trade_firm WHEN principal THEN surname2 || ' & ' || {r.pick('partner', ['Co', 'Bros', *SURNAMES[:9]])} WHEN NOT hired THEN '' WHEN dense THEN CASE WHEN {r.below('known_firm', 0.8)} THEN {r.pick('late_firm', LATE_FIRMS)} ELSE surname2 || ' & Co' END WHEN pastor THEN {r.pick('pastor_of', CHURCHES)} ELSE {r.pick('works', WORKS)} END",
            "job": f"CASE WHEN is_business THEN {r.pick('firm_trade', FIRM_TRADES)} WHEN widow THEN CASE WHEN {r.below('widow_jobless', 0.6)} THEN '' ELSE {r.pick('widow_trade', WOMENS_TRADES)} END WHEN principal AND {r.below('principal_jobless', 0.7)} THEN '' WHEN NOT hired THEN trade WHEN dense THEN {r.pick('late_post', LATE_POSTS)} WHEN pastor THEN 'pastor' ELSE {r.pick('mid_post', MID_POSTS)} END",
            "emp_of": "trade_firm <> '' AND NOT widow AND NOT is_business OR hired AND NOT dense AND pastor",
            "two": f"NOT is_business AND {r.below('two', by_era((.15, .35, .35)))}", "across": f"NOT is_business AND {r.below('across', 0.03)}",
        },
        {
            "name": f"CASE WHEN is_business THEN CASE WHEN {r.below('firm_caps', 0.30)} AND NOT {r.like('firm_name', '^[^A-Za-z]')} THEN upper(firm_name) ELSE firm_name END WHEN caps THEN upper(person) ELSE person END",
            "occupation_role": f"CASE WHEN NOT is_business AND NOT widow AND job <> '' AND employer = '' AND publisher IN ('polk', 'mb') AND year >= 1931 AND {r.below('mhn', 0.18)} THEN job || ' (Mhn)' ELSE job END",
            "home_plain": f"CASE WHEN two THEN CASE WHEN {r.below('home_do', 0.03)} THEN 'do' WHEN dense AND {r.below('home_far', 0.05)} THEN {r.pick('home_town', OUT_OF_TOWN)} WHEN dense AND {r.below('home_bkn', 0.15)} AND home_at NOT LIKE '%Bkn' THEN home_at || ' Bkn' ELSE home_at END WHEN across THEN home_at ELSE '' END",
            "primary_plain": f"CASE WHEN across THEN CASE WHEN era = 'early' THEN 'NY' ELSE {r.pick('across_form', ['NY', 'N Y', 'N. Y.'])} END ELSE primary_at END",
        },
        {
            "sole": f"NOT is_business AND home_plain = '' AND publisher <> 'mb' AND {r.below('sole', '''(CASE WHEN dense THEN 0.75e0 WHEN era = 'early' THEN 0.10e0 ELSE 0.30e0 END)''')}",
            "sole_mark": f"CASE WHEN dense THEN {r.weighted('sole_dense', DENSE_MARKS)} ELSE {r.weighted('sole_mark', SOLE_MARKS)} END",
            "sole_town": f"dense AND {r.below('sole_far', 0.10)}", "quarter_comma": r.below("quarter_comma", 0.80), "spaced": f"NOT is_business AND era = 'late' AND {r.below('spaced', 0.15)}",
            "comma": f"NOT is_business AND NOT ditto AND NOT caps AND {r.below('comma', by_era(COMMA))}",
        },
        {"sole_at": f"CASE WHEN sole AND sole_town THEN {r.pick('sole_town', OUT_OF_TOWN)} ELSE primary_plain END"},
        {
            "address": f"CASE WHEN NOT sole THEN sole_at ELSE sole_mark || CASE WHEN dense AND {r.like('sole_at', '^[0-9]')} AND sole_mark IN ('h', 'r', 'H', 'b') AND {r.below('sole_fused', 0.72)} THEN '' ELSE ' ' END || sole_at END",
            "home_address": "home_plain",
            "head_name": f"CASE WHEN own_name THEN surname || CASE WHEN {r.below('own_comma', 0.6)} THEN ', ' ELSE ' ' END || spouse_name || ' ' || substr(name, length(surname) + 2) WHEN comma THEN surname || ',' || substr(name, length(surname) + 1) ELSE name END",
            "head_race": "CASE WHEN race_designation IN ('', '*') OR substr(race_designation, 1, 1) = '(' THEN '' ELSE race_designation END",
        },
        {
            "head": f"CASE WHEN star AND NOT ditto THEN '*' ELSE '' END || {joined(' ', 'head_name', 'head_race')} || CASE WHEN principal THEN ' (' || employer || ')' ELSE '' END",
            "middle_part": f"{joined(' ', '''CASE WHEN substr(race_designation, 1, 1) = '(' THEN race_designation ELSE '' END''', '''CASE WHEN employer <> '' AND NOT principal AND emp_of THEN occupation_role || ' of' ELSE occupation_role END''', '''CASE WHEN principal THEN '' ELSE employer END''')}",
            "at_print": quarter_comma("address"), "home_print": quarter_comma("home_address"),
            "home_mark": f"CASE WHEN dense AND {r.below('home_fused', 0.70)} AND {r.like('home_address', '^[0-9]')} THEN {r.weighted('home_fused_mark', FUSED_MARKS)} ELSE {r.weighted('home_mark', HOME_MARKS)} || ' ' END",
        },
        {"line": f"CASE WHEN spaced THEN {joined(' ', 'head', '''CASE WHEN own_name THEN '' ELSE spouse_name END''', 'middle_part')} ELSE {joined(', ', 'head', '''CASE WHEN own_name THEN '' ELSE spouse_name END''', 'middle_part')} END || CASE WHEN spaced OR {r.below('at_space', 0.40)} THEN ' ' ELSE ', ' END || at_print || CASE WHEN home_print = '' THEN '' ELSE CASE WHEN spaced OR {r.below('home_space', 0.50)} THEN ' ' ELSE ', ' END || home_mark || home_print END"},
        {"clean_line": f"CASE WHEN {r.below('stop', 0.55)} AND line NOT LIKE '%.' THEN line || '.' ELSE line END", "profile": "'metropolis'", "alphabetical_range": "upper(substr(surname, 1, 3))"},
    ]
    return [r.stage(), *stages]


# ---------------------------------------------------------------- the town


def _town_address(r: Rolls) -> list[Stage]:
    side = f"CASE WHEN {r.below('side', 0.74)} THEN {r.pick('side_which', 'NSEW')} || ' ' ELSE '' END"
    roll = r.u("place")
    return [
        {"prefix": f"CASE WHEN quarter THEN {r.weighted('prefix', REAR_PREFIXES)} ELSE {r.weighted('prefix', PREFIXES)} END", "street_no": r.number("street_no", 1, 31), "corner_no": r.number("corner_no", 1, 12), "house": r.number("house", 1, 1900)},
        {"street": f"{side} || CASE WHEN {r.below('numbered', 0.20)} THEN {ordinal('street_no')} ELSE {joined(' ', f'''CASE WHEN quarter THEN {r.pick('quarter_street', TOWN_QUARTER)} ELSE {r.pick('street', TOWN_STREETS)} END''', r.weighted('street_kind', TOWN_KINDS))} END"},
        {"place": f"CASE WHEN {roll} < 0.05e0 AND prefix IN ('rms', 'b', '') THEN {r.pick('hotel', TOWN_HOTELS)} WHEN {roll} < 0.09e0 THEN cast({r.number('room', 1, 900)} as string) || ' ' || {r.pick('building', TOWN_BUILDINGS)} WHEN {roll} < 0.11e0 THEN street || ', ' || {r.pick('corner_a', 'ns')} || ' ' || {r.pick('corner_b', 'ew')} || ' cor ' || {ordinal('corner_no')} ELSE cast(house as string) || ' ' || street END"},
        {"address": f"{joined(' ', 'prefix', 'place')} || CASE WHEN {r.below('suburb', 0.045)} THEN ', ' || {r.pick('suburb_which', SUBURBS)} ELSE '' END", "home_address": "''"},
    ]


def town_stages(seed: int, engine: Engine = SPARK) -> list[Stage]:
    """Entries of a smaller city's volume of one year: from row_id, surname and surname2."""
    r = Rolls("town", seed, engine)
    kind = r.u("firm")
    suffix = r.pick("firm_suffix", TOWN_SUFFIXES)
    stages = [
        {"is_business": r.below("business", 0.06), "female": r.below("female", 0.30)},
        {"race_designation": f"CASE WHEN {r.below('race', '(CASE WHEN is_business THEN 0.05e0 ELSE 0.085e0 END)')} THEN '(c)' ELSE '' END"},
        {"quarter": f"race_designation = '(c)' AND (is_business OR {r.below('quarter', 0.6)})"},
        *_given(r, "given", "female", False), *_given(r, "wife", "true", False, 0), *_town_address(r),
        {
            "title": f"CASE WHEN female AND {r.below('title', 0.20)} THEN {r.pick('title_w', WOMENS_TITLES)} WHEN NOT female AND {r.below('title', 0.04)} THEN {r.pick('title_m', MENS_TITLES)} ELSE '' END",
            "firm_name": f"CASE WHEN {kind} < 0.4e0 THEN upper(surname) || ' ' || upper(surname2) || ' ' || {suffix} WHEN {kind} < 0.7e0 THEN upper(surname) || ' ' || {suffix} ELSE upper(surname) || ' ' || {r.pick('trade_word', TOWN_WORDS)} || ' CO' END",
            "occupation_role": f"CASE WHEN is_business THEN CASE WHEN {r.below('firm_line', 0.7)} THEN {r.pick('firm_which', TOWN_LINES)} ELSE '' END WHEN {r.below('jobless', 0.27)} THEN '' WHEN race_designation = '(c)' AND {r.below('served', 0.7)} THEN {r.pick('service', SERVICE_TRADES)} ELSE {r.weighted('job', TOWN_TRADES)} END",
        },
        {
            "name": f"CASE WHEN is_business THEN firm_name ELSE {joined(' ', 'surname', 'title', 'given', _initial(r, 'middle', 0.45))} END",
            "employer": f"CASE WHEN is_business OR occupation_role = '' THEN '' WHEN {r.below('employed', f'''(CASE WHEN {one_of('occupation_role', EMPLOYED)} THEN 0.55e0 ELSE 0.10e0 END)''')} THEN CASE WHEN {r.below('known_firm', 0.75)} THEN {r.pick('employer', TOWN_FIRMS)} ELSE surname2 || ' ' || {r.pick('employer_tail', TOWN_TAILS)} END ELSE '' END",
            "spouse_name": f"CASE WHEN is_business THEN '' WHEN NOT female AND {r.below('wife', 0.45)} THEN wife || CASE WHEN {r.below('wife_middle', 0.25)} THEN ' ' || {r.pick('wife_initial', INITIALS)} ELSE '' END WHEN female AND {r.below('widow', 0.30)} THEN 'wid ' || {r.pick('husband', MEN)} ELSE '' END",
        },
        {"line": f"{joined(', ', joined(' ', 'name', 'race_designation', '''CASE WHEN spouse_name = '' THEN '' ELSE '(' || spouse_name || ')' END'''), joined(' ', 'occupation_role', 'employer'), 'address')}"},
        {
            "clean_line": f"line || CASE WHEN {r.below('stop', 0.5)} THEN '.' ELSE '' END", "publisher": "'polk'", "directory_year": "'1921'", "era": "'late'", "ditto": "false", "profile": "'town'", "alphabetical_range": "upper(substr(surname, 1, 3))",
        },
    ]
    return [r.stage(), *stages]


# ---------------------------------------------------------------- noise, the whole


def noise_stages(seed: int, line: str, out: str, p: float, engine: Engine = SPARK) -> list[Stage]:
    """One or two edits of a line with chance p: a confusion, a comma lost, neighbours swapped, a dot put in.

    A roll for a lost comma in a line without one goes on to the swap; a confusion that isn't there changes nothing.
    """
    r = Rolls("noise", seed, engine)
    stages = [{"edits": f"CASE WHEN {r.below('noise', p)} THEN {r.number('edits', 1, 2)} ELSE 0 END", "edit0": line}]
    for k in (1, 2):
        x, n = f"edit{k - 1}", f"length(edit{k - 1})"
        stages += [
            {f"from{k}": r.pick(f"sub{k}", [a for a, _ in CONFUSIONS]), f"to{k}": r.pick(f"sub{k}", [b for _, b in CONFUSIONS]), f"roll{k}": r.u(f"roll{k}"), f"swap{k}": f"cast(floor({r.u(f'at{k}')} * ({n} - 1)) as int)", f"dot{k}": f"cast(floor({r.u(f'at{k}')} * {n}) as int)"},
            {f"at{k}": f"instr({x}, from{k})", f"comma{k}": f"instr({x}, ',')"},
            {f"edit{k}": f"CASE WHEN edits < {k} THEN {x} WHEN roll{k} < 0.5e0 THEN CASE WHEN at{k} > 0 THEN substr({x}, 1, at{k} - 1) || to{k} || substr({x}, at{k} + length(from{k})) ELSE {x} END WHEN roll{k} < 0.7e0 AND comma{k} > 0 THEN substr({x}, 1, comma{k} - 1) || substr({x}, comma{k} + 1) WHEN roll{k} < 0.85e0 AND {n} > 4 THEN substr({x}, 1, swap{k}) || substr({x}, swap{k} + 2, 1) || substr({x}, swap{k} + 1, 1) || substr({x}, swap{k} + 3) WHEN {n} > 0 THEN substr({x}, 1, dot{k}) || '.' || substr({x}, dot{k} + 1) ELSE {x} END"},
        ]
    return [r.stage(), *stages, {out: "edit2"}]


def staged(rows: DataFrame, stages: list[Stage]) -> DataFrame:
    """The rows with all stages' columns.

    Every few stages a row count is observed: that ends a span of generated code, which has a limit in size.
    """
    for k, stage in enumerate(stages, 1):
        rows = rows.withColumns({name: F.expr(e) for name, e in stage.items()})
        if k % SPAN == 0:
            rows = rows.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
    return rows


def as_sql(rows: str, stages: list[Stage]) -> str:
    """The same stages around a query's text."""
    for stage in stages:
        rows = f"SELECT *, {', '.join(f'{e} AS {name}' for name, e in stage.items())} FROM ({rows})"
    return rows


def add_noise(rows: DataFrame, line: str, seed: int, p: float) -> DataFrame:
    """``line`` with reading errors; rows: with row_id."""
    out = staged(rows.select("row_id", F.struct(*rows.columns).alias("_row"), F.col(line).alias("_line")), noise_stages(seed, "_line", "_noisy", p))
    return out.select(*[F.col("_noisy" if c == line else f"_row.{c}").alias(c) for c in rows.columns])


def base_stages(seed: int, mix: float, engine: Engine = SPARK) -> list[Stage]:
    """Draws of the inline pools, where no others are given, and of the profile."""
    r = Rolls("base", seed, engine)
    stage = {"city": r.below("city", mix), "surname": r.pick("surname", SURNAMES), "surname2": r.pick("surname2", SURNAMES), "occupation": r.weighted("occupation", TRADES)}
    return [r.stage(), stage]


#: What the stages leave, of both profiles.
COLUMNS = ["row_id", "profile", "era", "ditto", "publisher", "alphabetical_range", "directory_year", "clean_line", *FIELDS]


def generate(spark: SparkSession, n: int, seed: int = 7, noise: float = 0.35, mix: float = 0.75, surnames: DataFrame | None = None, occupations: DataFrame | None = None) -> DataFrame:
    """n examples: row_id, profile, era, ditto, raw_line, clean_line, context, record.

    mix: the large city's share.  surnames, occupations: pools (term, weight) to draw from instead of the inline ones.
    """
    d = Draws(seed, F.col("row_id"))
    rows = staged(spark.range(n).withColumnRenamed("id", "row_id"), base_stages(seed, mix))
    for pool, names in ((surnames, ["surname", "surname2"]), (occupations, ["occupation"])):
        for name in names if pool is not None else []:
            rows = pools.draw(rows.drop(name), d.u(f"pool_{name}"), pool, name)
    both = staged(rows.where("city"), city_stages(seed)).select(*COLUMNS).unionByName(staged(rows.where("not city"), town_stages(seed)).select(*COLUMNS))
    context = F.struct("publisher", "alphabetical_range", "directory_year")
    both = both.select("row_id", "profile", "era", "ditto", F.col("clean_line").alias("raw_line"), "clean_line", context.alias("context"), F.struct(*FIELDS).alias("record"))
    return add_noise(both, "raw_line", seed, noise)


# ---------------------------------------------------------------- statistics


def as_sql_rows(rows: str, seed: int, noise: float, mix: float, engine: Engine) -> str:
    """``generate`` as a query of another engine; rows: a query that gives row_id."""
    cols = ", ".join(COLUMNS)
    parts = [f"SELECT {cols} FROM ({as_sql(f'SELECT * FROM base WHERE {test}', stages(seed, engine))})" for test, stages in (("city", city_stages), ("NOT city", town_stages))]
    return f"WITH base AS ({as_sql(rows, base_stages(seed, mix, engine))}), entries AS ({' UNION ALL '.join(parts)}) SELECT * FROM ({as_sql('SELECT * FROM entries', noise_stages(seed, 'clean_line', 'raw_line', noise, engine))})"


def features(engine: Engine = SPARK) -> dict[str, str]:
    """Tests on generated rows before noise (but for ``noisy``): over the record's fields, profile, era, raw_line, clean_line."""
    quarters, towns = "|".join(QUARTERS), OUT_OF_TOWN
    ends = lambda x: f"({one_of(x, towns)})"
    like = Rolls("", 0, engine).like
    return {
        "business": "is_business", "two_addresses": "home_address <> ''", "spouse": "spouse_name <> ''", "widow": like("spouse_name", "^([Ww]id|w. of)"), "race": "race_designation <> ''",
        "no_occupation": "occupation_role = ''", "employer": "employer <> ''", "ditto": "ditto", "noisy": "raw_line <> clean_line",
        "era_early": "era = 'early'", "era_mid": "era = 'mid'", "era_late": "era = 'late'", "slash_year": "directory_year LIKE '%/%'",
        "ditto_dash": "name LIKE '-%'", "ditto_quote": "name LIKE '\"%'", "caps_business": f"is_business AND upper(name) = name AND {like('name', '[A-Z]')}", "caps_person": f"NOT is_business AND upper(name) = name AND {like('name', '[A-Z]')}",
        "surname_comma": like("clean_line", "^[A-Z][A-Za-z-]+,"), "widow_own_name": "spouse_name IN ('widow', 'wid.')", "widow_of": "spouse_name LIKE 'widow of%' OR spouse_name LIKE 'w. of%'",
        "wid_name": "spouse_name NOT IN ('', 'widow', 'wid.') AND spouse_name NOT LIKE 'widow of%' AND spouse_name NOT LIKE 'w. of%'",
        "sole_marked": like("address", "^(h|bds|r|b|H)[.]? "), "sole_fused": like("address", "^[hrbH][0-9]"), "fused_ordinal": f"{like('address', '(^|[^A-Za-z])[WE][0-9]+(st|d|th)')} OR {like('home_address', '(^|[^A-Za-z])[WE][0-9]+(st|d|th)')}",
        "room_code": like("address", " R ?[0-9]"), "cross_borough": "address LIKE '% Bkn' OR home_address LIKE '% Bkn'", "out_of_town": f"{ends('home_address')} OR {' OR '.join(f'''address LIKE '%{t}' ''' for t in towns)}",
        "short_early_street": like("address", "[A-Z][a-z]{0,5}[.] ?(st|street)"), "quarter_comma": like("clean_line", f", ({quarters})"), "employer_in_parentheses": "employer <> '' AND instr(clean_line, '(' || employer || ')') > 0",
        "star_race": "clean_line LIKE '*%' AND race_designation = '*'", "star_dropped": "clean_line LIKE '*%' AND race_designation <> '*'", "home_do": "home_address = 'do'",
        "hyphened_number": like("address", "[0-9]+-[0-9]+ "), "quarter": like("address", f" ({quarters})"), "hyphened_street": "address LIKE '%-st%' OR address LIKE '%-lane%'", "street_do": "address LIKE '% do.'",
        "commuter_tag": "instr(occupation_role, '(Mhn)') > 0", "stop_in_name": "instr(name, '.') > 0", "stop_in_occupation": "instr(occupation_role, '.') > 0", "works_across": "address IN ('NY', 'N Y', 'N. Y.')",
        "short_trade": one_of("occupation_role", SHORT_TRADES.values()), "goods": f"occupation_role LIKE '%&%' AND ({' OR '.join(f'''instr(occupation_role, '{g}') > 0''' for g in GOODS)})",
        "maker": f"{like('occupation_role', '[- ]maker$')} AND {like('occupation_role', '&| and ')}", "two_roles": f"occupation_role LIKE '% & %' AND {one_of('split_part(occupation_role, ' + chr(39) + ' & ' + chr(39) + ', 1)', SECOND_TRADES)}",
        "post_of": f"{one_of('occupation_role', CHURCH_POSTS)} AND employer <> '' OR {like('occupation_role', f'^({chr(124).join(POSTS)}) of ')}", "rear": like("address", "^(rear|ft) "), "corner": like("address", "^(cor|c|corner of) "), "between": "address LIKE 'bet %'", "suffix": like("name", " (jr|Jr|jun|sen|senr)[.]?$"),
    }


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "profile", "era", "ditto", "raw_line", "clean_line", "context.*", "record.*")


def statistics(rows: DataFrame, by: str | None = None) -> DataFrame:
    """feature, n, rows and an example line (of the least row_id) for each feature, in one pass; by: for each of its values (profile, publisher)."""
    tests = {k: F.expr(e) for k, e in features().items()}
    aggs = [F.struct(F.lit(k).alias("feature"), F.count_if(t).alias("n"), F.count("*").alias("rows"), F.min_by(F.when(t, F.col("clean_line")), F.when(t, F.col("row_id"))).alias("example")) for k, t in tests.items()]
    keys = [by] if by else []
    return _flat(rows).groupBy(*keys).agg(F.array(*aggs).alias("x")).select(*keys, F.explode("x").alias("x")).select(*keys, "x.*")


def publisher_mix(rows: DataFrame) -> DataFrame:
    """How many rows of each profile each publisher has."""
    return rows.groupBy("profile", F.col("context.publisher").alias("publisher")).agg(F.count("*").alias("n"))
