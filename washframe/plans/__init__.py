"""The cleaning plan and the registered queries with their oracle SQL."""
