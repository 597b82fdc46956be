"""Default settings of each analysis, as the study used them."""

from cohortline.operators.folds import SPLIT_SEED  # noqa: F401

SPLIT_TEST = 0.2

CRITERIA = ("gini", "entropy")  # log_loss is another name of entropy

TREE_GRID = {"criterion": CRITERIA, "max_depth": (3, 5, 7, 9)}
LINEAGE_TREE_GRID = {"criterion": CRITERIA, "max_depth": (3, 4, 5, 6)}
FOREST_GRID = {"n_trees": (10, 20, 30), "criterion": CRITERIA, "max_depth": (3, 5, 7, 9)}
LINEAGE_FOREST_GRID = {"n_trees": (100,), "criterion": CRITERIA, "max_depth": (3, 4, 5, 6)}
LOGISTIC_GRID = {"c": (0.01, 0.03, 0.1, 0.3, 1.0)}
KNN_GRID = {"k": (3, 5, 7, 9), "weights": ("uniform", "distance"), "p": (1, 2)}
PERCEPTRON_GRID = {"hidden": ((100,), (50, 50), (100, 50))}

# onset cutoff in weeks, model family, grid and score of each analysis
ANALYSES = {
    "tree": {"cutoff": 20, "family": "tree", "grid": TREE_GRID, "metric": "accuracy",
             "features": ["sex", "nursing_diet", "gestational_diet", "wt4", "wt8", "rbg4", "rbg8"]},
    "tree_sibling": {"cutoff": 28, "family": "tree", "grid": LINEAGE_TREE_GRID, "metric": "accuracy",
                     "features": ["sex", "nursing_diet", "wt4", "wt8", "rbg4", "rbg8", "rbg200_sib"]},
    "forest_lineage": {"cutoff": {"M": 28, "F": 28}, "family": "forest", "grid": LINEAGE_FOREST_GRID,
                       "metric": "auc",
                       "features": ["gestational_diet", "nursing_diet", "wt4", "wt8", "wt12"]},
    "sweep_forest": {"cutoff": 20, "family": "forest", "grid": FOREST_GRID, "metric": "accuracy"},
    "sweep_tree": {"cutoff": 40, "family": "tree", "grid": TREE_GRID, "metric": "accuracy"},
    "sweep_knn": {"cutoff": 32, "family": "knn", "grid": KNN_GRID, "metric": "accuracy"},
    "sweep_logistic": {"cutoff": 40, "family": "logistic", "grid": LOGISTIC_GRID, "metric": "accuracy"},
    "sweep_perceptron": {"cutoff": 32, "family": "perceptron", "grid": PERCEPTRON_GRID, "metric": "accuracy"},
    "comparison": {"cutoff": {"M": 16, "F": 36}, "folds": 5, "repeats": 10, "seed": 42},
}

FULL_COMPARISON = ("logistic", "ridge", "lasso", "knn", "forest", "tree", "perceptron")
