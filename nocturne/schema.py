"""Canonical sensor schema, enumerations and small dimension tables."""

from __future__ import annotations

from pyspark.sql import types as T

SENSOR = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("hr", T.IntegerType()),
        T.StructField("rr_count", T.IntegerType()),
        T.StructField("rr1_ms", T.DoubleType()),
        T.StructField("rr2_ms", T.DoubleType()),
        T.StructField("rr3_ms", T.DoubleType()),
        T.StructField("acc_x", T.DoubleType()),
        T.StructField("acc_y", T.DoubleType()),
        T.StructField("acc_z", T.DoubleType()),
        T.StructField("movement", T.DoubleType()),
        T.StructField("gyro", T.DoubleType()),
        T.StructField("spo2", T.IntegerType()),
    ]
)

# Stage names with their class number, the stage names used in
# official documents, and the hypnogram numbers.
STAGE_CODE = {"awake": 0, "light": 1, "deep": 2, "rem": 3}
STAGES = ["awake", "light", "deep", "rem"]
OFFICIAL_STAGE = {
    "AWAKE": "awake",
    "LIGHT_SLEEP": "light",
    "SWS_SLEEP": "deep",
    "REM_SLEEP": "rem",
}
HYPNOGRAM_CODE = {"awake": 0, "light": 2, "deep": 3, "rem": 4}

# Absolute heart-rate zones (inclusive bounds) and their weights.
ABSOLUTE_ZONES = [
    (0, 108, 0.0),
    (109, 135, 1.0),
    (136, 149, 2.5),
    (150, 162, 5.0),
    (163, 176, 10.0),
    (177, 189, 20.0),
]

# Share-of-maximum zones and their weights.
RELATIVE_BOUNDS = [0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
RELATIVE_WEIGHTS = [1.0, 2.0, 4.0, 8.0, 16.0]

# Command codes of the packet log.
COMMAND_NAMES = {
    0x0E: "ALARM_CONFIG",
    0x13: "CONFIGURE_SENSOR",
    0x16: "GET_STRAP_STATUS",
    0x17: "READ_FLASH_DATA",
    0x22: "HISTORY_QUERY",
    0x42: "HISTORY_RANGE_REQUEST",
    0x8D: "GET_DEVICE_NAME",
    0x91: "GET_DEVICE_SERIAL",
}

# Journal behaviours by category.
BEHAVIOURS = {
    "Sleep": ["Shared Bed", "Dark Room", "Blue Light Blocker", "Nap", "Sleep Mask", "White Noise"],
    "Diet": ["Caffeine", "Alcohol", "Late Meal", "Hydrated", "Supplements", "Melatonin", "Fasting"],
    "Activity": ["Exercise", "Stretching", "Yoga", "Sauna", "Cold Exposure", "Massage"],
    "Mind": ["Meditation", "Screen Time", "Reading", "Breathwork", "Nature Time"],
    "Health": ["Sick", "Allergies", "Medication", "Travel"],
}

# Sport ids with their names.
SPORTS = {
    -1: "Activity", 0: "Running", 1: "Cycling",
    16: "Baseball", 17: "Basketball", 18: "Rowing", 19: "Fencing",
    20: "Field Hockey", 21: "Football", 22: "Golf", 24: "Ice Hockey",
    25: "Lacrosse", 27: "Rugby", 28: "Sailing", 29: "Skiing", 30: "Soccer",
    31: "Softball", 32: "Squash", 33: "Swimming", 34: "Tennis",
    35: "Track & Field", 36: "Volleyball", 37: "Water Polo", 38: "Wrestling",
    39: "Boxing", 42: "Dance", 43: "Pilates", 44: "Yoga", 45: "Weightlifting",
    47: "Cross Country Skiing", 48: "Functional Fitness", 49: "Duathlon",
    51: "Gymnastics", 52: "Hiking/Rucking", 53: "Horseback Riding",
    55: "Kayaking", 56: "Martial Arts", 57: "Mountain Biking",
    59: "Powerlifting", 60: "Rock Climbing", 61: "Paddleboarding",
    62: "Triathlon", 63: "Walking", 64: "Surfing", 65: "Elliptical",
    66: "Stairmaster", 70: "Meditation", 71: "Other", 73: "Diving",
    82: "Ultimate", 83: "Climber", 84: "Jumping Rope",
    85: "Australian Football", 86: "Skateboarding", 87: "Coaching",
    88: "Ice Bath", 89: "Commuting", 90: "Gaming", 91: "Snowboarding",
    92: "Motocross", 93: "Caddying", 94: "Obstacle Course Racing",
    95: "Motor Racing", 96: "HIIT", 97: "Spin", 98: "Jiu Jitsu",
    99: "Manual Labor", 100: "Cricket", 101: "Pickleball",
    102: "Inline Skating", 103: "Box Fitness", 104: "Spikeball",
    105: "Wheelchair Pushing", 106: "Paddle Tennis", 107: "Barre",
    108: "Stage Performance", 109: "High Stress Work", 110: "Parkour",
    111: "Gaelic Football", 112: "Hurling/Camogie", 113: "Circus Arts",
    121: "Massage Therapy", 123: "Strength Trainer", 125: "Watching Sports",
    126: "Assault Bike", 127: "Kickboxing", 128: "Stretching",
    230: "Table Tennis", 231: "Badminton", 232: "Netball", 233: "Sauna",
    234: "Disc Golf", 235: "Yard Work", 236: "Air Compression",
    237: "Percussive Massage", 238: "Paintball", 239: "Ice Skating",
    240: "Handball", 248: "F45 Training", 249: "Padel", 250: "Barry's",
    251: "Dedicated Parenting", 252: "Stroller Walking",
    253: "Stroller Jogging", 254: "Toddlerwearing", 255: "Babywearing",
    258: "Barre3", 259: "Hot Yoga", 261: "Stadium Steps", 262: "Polo",
    263: "Musical Performance", 264: "Kite Boarding", 266: "Dog Walking",
    267: "Water Skiing", 268: "Wakeboarding", 269: "Cooking",
    270: "Cleaning", 272: "Public Speaking",
}


def sport_table(spark):
    """Sport dimension; its size is fixed by the catalogue above."""
    return spark.createDataFrame(
        [(k, v) for k, v in SPORTS.items()], "sport_id int, sport_name string"
    )


def behaviour_table(spark):
    """Behaviour dimension; its size is fixed by the catalogue above."""
    rows = [(c, b) for c, names in BEHAVIOURS.items() for b in names]
    return spark.createDataFrame(rows, "category string, behaviour string")
