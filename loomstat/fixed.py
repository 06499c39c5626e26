"""Fixed values.  They must stay as they are for results to match."""

# Survey codes meaning "refused" or "don't know", by column.
SENTINEL_CODES: dict[str, list[float]] = {
    "drinks_per_day": [777, 999],
    "alc_freq_past12mo": [777, 999],
    "intense_activity_work": [7, 9],
    "some_activity_work": [7, 9],
    "monthly_family_income": [77, 99],
    "has_20k_savings": [7, 9],
    "total_savings": [77, 99],
    "ever_smoked_100": [7, 9],
    "sex": [7, 9],
    "race_ethnicity": [7, 9],
    "has_health_insurance": [7, 9],
    "daily_sedentary_activity": [7777, 9999],
    "daily_intense_work": [7777, 9999],
    "weekly_hrs_worked": [77777, 99999],
}

# Percentile trim bounds.
TRIM_LOWER = 0.05
TRIM_UPPER = 0.95

# Split share and seed.
TEST_SHARE = 0.2
SEED = 42

# Study budget and fold counts.
STUDY_FOLDS = 3
STUDY_TRIALS = 10
STUDY_SECONDS = 120
GRID_FOLDS = 5
RANDOM_FOLDS = 10
RANDOM_DRAWS = 5
SEARCH_WORKERS = 3
CV_STUDY_FOLDS = [3, 5, 10, 20]

# Ranges of the budgeted study.
# ("int", low, high) and ("float", low, high) include both ends, "log" draws on a log scale.
STUDY_SPACES: dict[str, dict[str, tuple]] = {
    "random_forest": {
        "n_estimators": ("int", 100, 1000),
        "max_depth": ("int", 3, 30),
        "min_samples_split": ("int", 2, 20),
        "min_samples_leaf": ("int", 1, 10),
        "max_features": ("choice", ["sqrt", "log2"]),
    },
    "gradient_boosting": {
        "n_estimators": ("int", 50, 1500),
        "learning_rate": ("float", 0.0001, 0.3),
        "max_depth": ("int", 3, 10),
        "subsample": ("float", 0.4, 1.0),
        "min_samples_leaf": ("int", 1, 50),
        "max_features": ("choice", ["sqrt", "log2", None]),
    },
    "knn": {
        "n_neighbors": ("int", 5, 50),
        "weights": ("choice", ["uniform", "distance"]),
    },
    "svr": {
        "C": ("float", 0.1, 100.0),
        "epsilon": ("float", 0.01, 1.0),
        "gamma": ("log", 1e-4, 1e-1),
        "kernel": ("choice", ["rbf"]),
    },
    "xgboost": {
        "n_estimators": ("int", 100, 1500),
        "max_depth": ("int", 3, 20),
        "learning_rate": ("log", 0.0001, 0.3),
        "subsample": ("float", 0.4, 1.0),
        "colsample_bytree": ("float", 0.4, 1.0),
        "min_child_weight": ("int", 1, 20),
        "gamma": ("float", 0.0, 10.0),
        "reg_alpha": ("float", 0.0, 10.0),
        "reg_lambda": ("float", 0.1, 10.0),
    },
}

# Exhaustive grids.
GRIDS: dict[str, dict[str, list]] = {
    "random_forest": {
        "n_estimators": [100, 300],
        "max_depth": [10, 30],
        "min_samples_split": [2, 10],
        "min_samples_leaf": [1, 5],
        "max_features": ["sqrt", "log2"],
    },
    "gradient_boosting": {
        "n_estimators": [100, 300],
        "learning_rate": [0.01, 0.1],
        "max_depth": [3, 5],
        "subsample": [0.5, 1.0],
        "min_samples_leaf": [1, 5],
    },
    "knn": {
        "n_neighbors": [5, 10, 20],
        "weights": ["uniform", "distance"],
    },
    "svr": {
        "C": [0.1, 1, 10],
        "epsilon": [0.01, 0.1],
        "kernel": ["rbf"],
    },
    "xgboost": {
        "n_estimators": [100, 300],
        "max_depth": [3, 6],
        "learning_rate": [0.01, 0.1],
        "subsample": [0.5, 1.0],
        "colsample_bytree": [0.5, 1.0],
    },
}

# Distributions of the random search.
# ("int", low, high) includes both ends; ("float", low, high) is uniform.
RANDOM_SPACES: dict[str, dict[str, tuple]] = {
    "random_forest": {
        "n_estimators": ("int", 100, 999),
        "max_depth": ("int", 3, 29),
        "min_samples_split": ("int", 2, 19),
        "min_samples_leaf": ("int", 1, 9),
        "max_features": ("choice", ["sqrt", "log2"]),
    },
    "gradient_boosting": {
        "n_estimators": ("int", 100, 999),
        "learning_rate": ("float", 0.001, 0.301),
        "max_depth": ("int", 3, 9),
        "subsample": ("float", 0.5, 1.0),
        "min_samples_leaf": ("int", 1, 9),
    },
    "knn": {
        "n_neighbors": ("int", 5, 49),
        "weights": ("choice", ["uniform", "distance"]),
    },
    "svr": {
        "C": ("float", 0.1, 100.1),
        "epsilon": ("float", 0.01, 1.01),
        "kernel": ("choice", ["rbf"]),
    },
    "xgboost": {
        "n_estimators": ("int", 100, 999),
        "max_depth": ("int", 3, 14),
        "learning_rate": ("float", 0.001, 0.301),
        "subsample": ("float", 0.5, 1.0),
        "colsample_bytree": ("float", 0.5, 1.0),
    },
}

# The wider interactive grids (drawn from at random, 12 shuffled folds).
WIDE_FOLDS = 12
WIDE_DRAWS = 100
WIDE_CV_STUDY_FOLDS = [3, 6, 12, 24, 48]
WIDE_GRIDS: dict[str, dict[str, list]] = {
    "random_forest": {
        "n_estimators": [100, 300, 500, 800, 1000],
        "max_depth": [None, 10, 20, 30, 50],
        "min_samples_split": [2, 4, 6, 8, 10],
        "max_features": ["sqrt", "log2", None],
    },
    "gradient_boosting": {
        "n_estimators": [100, 300, 500, 800],
        "learning_rate": [0.01, 0.05, 0.1],
        "max_depth": [3, 5, 7],
        "subsample": [0.8, 1.0],
    },
    "knn": {
        "n_neighbors": [3, 5, 7, 9, 11, 15],
        "weights": ["uniform", "distance"],
        "p": [1, 2],
    },
    "svr": {
        "C": [0.1, 1.0, 10.0, 100.0],
        "epsilon": [0.01, 0.1, 0.5],
        "kernel": ["rbf", "linear", "poly"],
    },
    "ridge": {
        "alpha": [0.01, 0.1, 1.0, 10.0, 100.0],
    },
}
