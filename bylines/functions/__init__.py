"""Column functions: labels, groups, names, bins and chi-square tails."""
