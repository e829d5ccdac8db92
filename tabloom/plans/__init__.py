"""Plans of steps over named tables, recipes, and guarded SQL: checked against schemas first, then lowered lazily."""
