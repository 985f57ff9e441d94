"""DataFrame -> DataFrame operators; none of them triggers an action unless it says so."""
