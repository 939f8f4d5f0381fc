"""Two specifications that drawings are checked against, as pages: one for dwellings, one for boards."""

from __future__ import annotations

#: Limits of the two specifications.
CORRIDOR_MM, DOOR_MM, BATH_DOOR_MM = 1100, 800, 750
AREAS_M2 = {"BEDROOM": 9.5, "LIVING": 13.0, "KITCHEN": 5.5, "STUDY": 6.5}
CAPACITY_A = {1.5: 16, 2.5: 25, 4.0: 32, 6.0: 40, 10.0: 50}
RUN_M = {1.5: 25, 2.5: 35, 4.0: 45, 6.0: 55, 10.0: 70}
LIGHTING_A, MAIN_A, LOAD_PERCENT, VOLTS, RCD_MA, LIGHTS, SOCKETS = 10, 63, 80, 230, 30, 10, 8


def _sizes(table: dict[float, int], between: str, unit: str) -> str:
    return "; ".join(f"{size:g} sq mm{between} {value} {unit}" for size, value in table.items())


#: The wordings that limits are read from, by what they limit.
SAID = {
    **{f"area of a {kind.lower()}": f"The minimum floor area of a {kind.lower()} is not less than {area:g} square metres." for kind, area in AREAS_M2.items()},
    "corridor": f"An internal corridor has a minimum clear width of not less than {CORRIDOR_MM} mm.",
    "door": f"Doors serving habitable rooms have a clear opening width of not less than {DOOR_MM} mm.",
    "bath door": f"A bathroom door has a clear opening width of not less than {BATH_DOOR_MM} mm.",
    "window": "Every habitable room has a window in an external wall.",
    "rcd": f"All circuits supplying socket outlets have a residual current device (RCD) with a rated current not exceeding {RCD_MA} mA.",
    "breaker": f"The rating of a circuit breaker shall not exceed the current-carrying capacity of the cable: {_sizes(CAPACITY_A, ' cable', 'A')}.",
    "lighting": f"Lighting circuits are protected by breakers rated not more than {LIGHTING_A} A.",
    "main": f"The main switch of a distribution board is rated not less than {MAIN_A} A.",
    "load": f"The connected load of a final circuit shall not exceed {LOAD_PERCENT} percent of the breaker rating multiplied by {VOLTS} V.",
    "lights": f"A lighting circuit shall supply not more than {LIGHTS} luminaires.",
    "sockets": f"A socket circuit shall supply not more than {SOCKETS} socket outlets.",
    "length": f"Against voltage drop, cable run lengths shall not exceed: {_sizes(RUN_M, '', 'm')}.",
}

#: Chapters and what each says: a key of ``SAID``, or a remark on how this library reads drawings.
CHAPTERS = {
    "building": [
        ("Floor areas", [*(f"area of a {kind.lower()}" for kind in AREAS_M2), "Areas are those of the closed outlines, whatever stands inside."]),
        ("Openings", ["window", "A window counts for each outline that it touches within the tolerance of the sheet.", "bath door", "door"]),
        ("Passages", ["An outline whose name holds the word corridor is taken for one; of several the largest is looked at.", "corridor"]),
        ("How sheets are read", ["Names of outlines are the texts that lie inside, in the order of the file.", "The scale of a door's block is the gap that it leaves in the wall.", "A sheet without a unit is measured in its own numbers."]),
    ],
    "electrical": [
        ("Protection", ["rcd", "lighting", "A device protects what lies farther from the supply than itself."]),
        ("Sizing", ["length", "breaker", "main", "A size that the tables leave out is not looked at."]),
        ("Filling of circuits", ["sockets", "lights", "load", "What a circuit carries is the sum of all loads beyond its breaker."]),
        ("How boards are read", ["Ends of conductors that touch are one net.", "Of two symbols with one tag the later one counts.", "The first supply of the file is where distances begin."]),
    ],
}


def sections(name: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """Titles and numbered clauses of the ``building`` or the ``electrical`` specification."""
    return [(f"{i} {title}", [(f"{i}.{j}", SAID.get(said, said)) for j, said in enumerate(held, 1)]) for i, (title, held) in enumerate(CHAPTERS[name], 1)]


def spec_pages(name: str, per_page: int = 2) -> list[tuple[str, int, str]]:
    """(source, page, text) of a specification, some sections to a page."""
    told = ["\n".join([title, *(f"{number} {text}" for number, text in clauses)]) for title, clauses in sections(name)]
    return [(name, i // per_page + 1, "\n".join(told[i : i + per_page])) for i in range(0, len(told), per_page)]


def clause(name: str, said: str) -> str:
    """The number of the clause that says a key of ``SAID`` or a remark."""
    return next(number for _, clauses in sections(name) for number, text in clauses if text == SAID.get(said, said))


#: Questions in words other than the clauses', and what answers each.
ASKED = {
    "building": [
        (text, clause("building", said))
        for text, said in [
            ("How wide must the hallway corridor be at least?", "corridor"), ("clear opening for doors of habitable rooms", "door"), ("width of the door to a bathroom", "bath door"), ("smallest permitted floor area for a bedroom", "area of a bedroom"),
            ("square metres required of the kitchen", "area of a kitchen"), ("does every habitable room need a window", "window"), ("which gap in the wall does a door's block leave", "The scale of a door's block is the gap that it leaves in the wall."), ("what is a sheet without a unit measured in", "A sheet without a unit is measured in its own numbers."),
        ]
    ],
    "electrical": [
        (text, clause("electrical", said))
        for text, said in [
            ("largest breaker for lighting circuits", "lighting"), ("rating of the main switch on the board", "main"), ("share of the breaker rating a connected load may take", "load"), ("how many luminaires on one lighting circuit", "lights"),
            ("residual current device for socket outlets", "rcd"), ("longest cable run against voltage drop", "length"), ("capacity of cable against circuit breaker rating", "breaker"), ("where do distances begin, at which supply", "The first supply of the file is where distances begin."),
        ]
    ],
}
