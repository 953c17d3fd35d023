"""``python -m tickloom [query --tables DIR --out DIR]``."""

from tickloom.plans.dag import main

main()
