"""Fixed values of the expected results, kept apart from the library so that a wrong one there shows."""

# Component groups, recall types, body styles, noise and failure patterns.
COMPONENT_GROUPS = {
    "BRAKES & BRAKING SYSTEMS": [
        "SERVICE BRAKES, HYDRAULIC", "SERVICE BRAKES", "SERVICE BRAKES, AIR", "SERVICE BRAKES, ELECTRIC",
        "PARKING BRAKE",
    ],
    "ENGINE & COOLING": ["ENGINE", "ENGINE AND ENGINE COOLING"],
    "FUEL & PROPULSION SYSTEM": [
        "FUEL SYSTEM, GASOLINE", "FUEL/PROPULSION SYSTEM", "FUEL SYSTEM, OTHER", "FUEL SYSTEM, DIESEL",
        "HYBRID PROPULSION SYSTEM",
    ],
    "ELECTRONIC STABILITY & TRACTION": [
        "ELECTRONIC STABILITY CONTROL (ESC)", "ELECTRONIC STABILITY CONTROL", "TRACTION CONTROL SYSTEM",
    ],
    "VISIBILITY & WIPERS": ["VISIBILITY", "VISIBILITY/WIPER"],
    "LIGHTING SYSTEMS": ["EXTERIOR LIGHTING", "INTERIOR LIGHTING"],
    "TIRES & WHEELS": ["TIRES", "WHEELS"],
    "ADAS & ADVANCED TECHNOLOGY": [
        "FORWARD COLLISION AVOIDANCE", "LANE DEPARTURE", "BACK OVER PREVENTION", "COMMUNICATION",
    ],
    "EQUIPMENT & ACCESSORIES": ["EQUIPMENT", "EQUIPMENT ADAPTIVE/MOBILITY", "TRAILER HITCHES"],
    "CHILD SEAT & RESTRAINT EQUIPMENT": [
        "CHILD SEAT", "CHEST CLIP, BUCKLE, HARNESS", "CARRY HANDLE, SHELL, BASE",
        "TETHER, LOWER ANCHOR (ON CAR SEAT OR VEHICLE)", "INSERT, PADDING",
    ],
    "OTHER / UNKNOWN": [
        "UNKNOWN OR OTHER", "OTHER/I AM NOT SURE", "OTHER/UNKNOWN", "NONE", "1", "120", "FIRERELATED", "",
    ],
}

RECALL_TYPES = {
    "V": "VEHICLE RECALL",
    "E": "EQUIPMENT RECALL",
    "T": "TIRE RECALL",
    "C": "CHILD SEAT RECALL",
}

BODY_STYLE_CATEGORIES = {
    "2 DR": "2-Door Coupe",
    "3 HB": "Hatchback",
    "3C": "Coupe",
    "4": "4-Door Sedan",
    "4 DR": "4-Door Sedan",
    "4 DR Early Release": "4-Door Sedan",
    "4DR": "4-Door Sedan",
    "4DR SUV": "SUV",
    "5 HB": "Hatchback",
    "5HB": "Hatchback",
    "C": "Coupe",
    "EXTENDED SUV": "SUV",
    "HYBRID PU/CC": "Pickup Truck",
    "MV": "Minivan",
    "PU/CC": "Pickup Truck",
    "PU/CC Early Release": "Pickup Truck",
    "PU/CC Later Release": "Pickup Truck",
    "PU/EC": "Pickup Truck",
    "PU/RC": "Pickup Truck",
    "PV": "Passenger Van",
    "PV LATER RELEASE": "Passenger Van",
    "SUV": "SUV",
    "SUV EARLY RELEASE": "SUV",
    "SUV Early Release": "SUV",
    "SUV Later Release": "SUV",
    "SW": "Station Wagon",
    "VAN": "Van",
    "WAGON": "Station Wagon",
}

COMPLAINT_NOISE = (
    r"(?i)^no summary|^see attached|^n/a$|^none$|^na$|^not applicable$|^unknown$|^takata recall$"
)

RECALL_NOISE = r"(?i)LABELS|ADAPTIVE/MOBILITY|EQUIPMENT:OTHER|UNKNOWN|OTHER/I AM NOT SURE"

FAILURE_PATTERNS = {
    r"(?i)^transmission.*fail": "TRANSMISSION FAILURE",
    r"(?i)^brake.*fail": "BRAKE FAILURE",
    r"(?i)^engine.*fail": "ENGINE FAILURE",
    r"(?i)^power train": "POWER TRAIN",
    r"(?i)^air bag": "AIR BAGS",
    r"(?i)^air bags": "AIR BAGS",
    r"(?i)^electrical.*system": "ELECTRICAL SYSTEM",
    r"(?i)^service brake": "SERVICE BRAKES",
    r"(?i)^steering.*": "STEERING",
    r"(?i)^seat belt": "SEAT BELTS",
    r"(?i)^fuel system": "FUEL SYSTEM",
}
