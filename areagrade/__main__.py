from areagrade.plans.job import main

main()
