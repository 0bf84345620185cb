"""Column functions: cleaning, predicates and labelling rules."""
