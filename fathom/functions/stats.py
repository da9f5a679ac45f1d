"""Statistical constants."""

# Upper 5% points of the chi-square distribution for 1..10
# degrees of freedom (standard statistical tables).
CHI2_CRITICAL_005 = {1: 3.841, 2: 5.991, 3: 7.815, 4: 9.488, 5: 11.070,
                     6: 12.592, 7: 14.067, 8: 15.507, 9: 16.919, 10: 18.307}


def chi2_critical(dof: int) -> float:
    if dof in CHI2_CRITICAL_005:
        return CHI2_CRITICAL_005[dof]
    # Wilson-Hilferty approximation beyond the table
    z = 1.6448536269514722
    return dof * (1 - 2 / (9 * dof) + z * (2 / (9 * dof)) ** 0.5) ** 3
