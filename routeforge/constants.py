"""Fixed values of the data model.

The numbers, names and category orders below are facts of the data and of the
published feature contract; results only agree when they are kept exactly.
"""

FIELD_LENGTH = 120.0
FIELD_WIDTH = 53.3

PLAY_KEYS = ["gameId", "playId"]
ROUTE_KEYS = ["gameId", "playId", "nflId"]

# Frames of a route that count, measured from the first frame after the snap.
MAX_ROUTE_FRAME = 50
SECONDS_PER_FRAME = 0.1

# Route names as charted -> the eight route classes.
ROUTE_CLASS = {
    "GO": "straight",
    "HITCH": "shortstraight",
    "SLANT": "early45angle",
    "CROSS": "early45angle",
    "POST": "late45angle",
    "CORNER": "late45angle",
    "OUT": "90angle",
    "IN": "90angle",
    "FLAT": "flat",
    "SCREEN": "screen",
    "ANGLE": "wheelangle",
    "WHEEL": "wheelangle",
}
ROUTE_CLASSES = [
    "early45angle",
    "flat",
    "90angle",
    "late45angle",
    "shortstraight",
    "wheelangle",
    "screen",
    "straight",
]

# Shape of one route: 13 numbers.
SHAPE_FEATURES = [
    "x_median", "x_std", "x_5", "x_20", "x_40",
    "y_median", "y_std", "y_5", "y_20", "y_40",
    "coef_a", "coef_b", "coef_c",
]
SHAPE_POSITIONS = [5, 20, 40]

# Depth of the zone past the line of scrimmage: name -> [low, high).
DEPTH_BANDS = {
    "nb_recep_zone_negative": (None, 0.0),
    "nb_recep_zone_5": (0.0, 5.0),
    "nb_recep_zone_10": (5.0, 10.0),
    "nb_recep_zone_20": (10.0, 20.0),
    "nb_recep_zone_inf": (20.0, None),
}

# Inputs of the open-receiver model: 31 columns, of which 5 are categories.
OPEN_FEATURES = [
    "down", "yardsToGo", "offenseFormation", "receiverAlignment", "playAction",
    "position", "route_mode", "route_time_mean", "dis_recep_zone", "dir_recep_zone",
    "recep_zone_dis_out_of_bounds", "recep_zone_dis_yard_line", "dis_out_of_bounds",
    "dis_back_of_endzone", "dis_yard_line", "nb_early45angle", "nb_flat", "nb_90angle",
    "nb_late45angle", "nb_shortstraight", "nb_wheelangle", "nb_screen", "nb_straight",
    "nb_routes", "nb_recep_zone_negative", "nb_recep_zone_5", "nb_recep_zone_10",
    "nb_recep_zone_20", "nb_recep_zone_inf", "dis_ball_to_recep_zone",
    "dir_ball_to_recep_zone",
]
OPEN_CATEGORIES = ["offenseFormation", "receiverAlignment", "playAction", "route_mode", "position"]

ROUTE_TIME_FEATURES = ["route_mode", "dis_recep_zone", "dir_recep_zone"]
ROUTE_TIME_CATEGORIES = ["route_mode"]

ZONE_TARGETS = ["relative_x_mean", "relative_y_mean", "route_frameId_mean"]
ZONE_COLUMNS = [
    "cluster",
    "relative_x_min", "relative_x_max", "relative_x_mean",
    "relative_y_min", "relative_y_max", "relative_y_mean",
    "route_frameId_mean", "route_time_mean",
]
