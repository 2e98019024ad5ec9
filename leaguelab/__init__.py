"""leaguelab: league and tournament analytics as PySpark DataFrame operators."""
