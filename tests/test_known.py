"""Known results: two sequences of 6001 bases, cut to 1300 around the start site, under two matrices of nine rows."""

from motifspark.operators import features
from motifspark.operators.kernel import Pwm
from motifspark.plans import commands
from motifspark.sources.readers import normalise

# fixed values: sequences, places of their start sites, matrices, and the 24 features of each: strands, matrices, tiles from 500 before to 100 after
SEQUENCES = [
    (
        "GTTCGTAAGACACATACATTGTTCCATGATAAAATGCAACCCCACGAACCATTTGCGACAAGCAAAACAACATGGTCAAAATTAAAAGCTAACAATTAGCCAGCGATTCAAAAAGTCAAC"
        "CTTCTAGATGGATTTAACAACATATCGATAGGATTCAAGATTAAAAATAAGCACACTCTTATTAATGTTAAAAAACGAATGAGATGAAAATATTTGGCGTGTTCACACACATAATCTAGA"
        "AGACAGATTCGAGTTGCTCTCCTTTGTTTTGCTTTGGGAGGGACCCATTATTACCGCCCAGCAGCTTCCCAGCCTTCCTTTATAAGGCTTAATTTATATTTATTTAAATTTTATATGTTC"
        "TTCTATTATAATACTAAAAGGGGAATACAAATTTCTACAGAGGATGATATTCAATCCACGGTTCACCCAAACCGATTTTATAAAATTTATTATTAAATCTTTTTTAATTGTTAAATTGGT"
        "TTAAATCTGAACTCTGTTTACTTACATTGATTAAAATTCTAAACCATCATAAGTAAAAAATAATATGATTAAGACTAATAAATCTTAATAGTTAATACTACTCGGTTTACTACATGAAAT"
        "TTCATACCATCAATTGTTTTAATAATCTTTAAAATTGTTAGGACCGGTAAAACCATACCAATTAAACCGGAGATCCATATTAATTTAATTAAGAAAATAAAAATAAAAGGAATAAATTGT"
        "CTTATTTAAACGCTGACTTCACTGTCTTCCTCCCTCCAAATTATTAGATATACCAAACCAGAGAAAACAAATACATAATCGGAGAAATACAGATTACAGAGAGCGAGAGAGATCGACGGC"
        "GAAGCTCTTTACCCGGAAACCATTGAAATCGGACGGTTTAGTGAAAATGGAGGATCAAGTTGGGTTTGGGTTCCGTCCGAACGACGAGGAGCTCGTTGGTCACTATCTCCGTAACAAAAT"
        "CGAAGGAAACACTAGCCGCGACGTTGAAGTAGCCATCAGCGAGGTCAACATCTGTAGCTACGATCCTTGGAACTTGCGCTGTAAGTTCCGAATTTTCTGAATTTCATTTGCAAGTAATCG"
        "ATTTAGGTTTTTGATTTTAGGGTTTTTTTTTGTTTTGAACAGTCCAGTCAAAGTACAAATCGAGAGATGCTATGTGGTACTTCTTCTCTCGTAGAGAAAACAACAAAGGGAATCGACAGA"
        "GCAGGACAACGGTTTCTGGTAAATGGAAGCTTACCGGAGAATCTGTTGAGGTCAAGGACCAGTGGGGATTTTGTAGTGAGGGCTTTCGTGGTAAGATTGG"
    ),
    (
        "AATATGTAGGCCGGTTAGGGTTTTCATAGGCATGATTAATGATGATAAGGAAACTTCGTATTGGGGGTTAATGGGTTCTTTCCCTTTCTAATACATTTCTAAATAAAGTAATAATCAAAT"
        "ATTAAACTTTTAACTTACCGTTTCATTTTTATGTTGAGTTTACTTATATTGAAAGGAAACTATTTTATCTAAACCTCATTGTCAAATCTTTCATTTTGTAGCCATATGCTAATTACATGC"
        "AACAAAAGGAGTTTTTTTTGTTTGGTGTGGCAAACGAAGATTTATTTACCTTTCTTATTTAATCAAACTAAATAAATTTCTTCACTGTTGAATTGTAATAAATAATTTATTTTCTTATAA"
        "ACTTATCCATCACAACTCACAAGTCATGAACTATATATAGAAAGTAACACGACAGTAATAATATTAGTGAACCACTAGACTTTTCAGTAAGTGTGGTAAATTCTGAAGACTAAATAATTT"
        "AGACTTAATATGTATATCTTTATCTGAGGCCTATAATATGTTTCATTCATGAACCTACGCATTTTAAAATGCTATGTCATATGGACAAGATTTTGATCCAAATTGAACTATTTATAAATT"
        "ACAACGTGTATATGATTTTTAAATTTTGGGGTACAAATACCCCGGCTTAGAGCAAAAGTGGGCCTAACAAATTTAAAGTTAAGACTTCAAAAACTTGGCCCATGAATAAGCCCATTTAGG"
        "GTTAAAACAGTAGCCCAGACCCGGACTCTAATTGCTCCGTATTCTTCTTCTCTTGAGAGAGAGAGAGAGAGAGAGAGAGAGAGAGCAATGGCGGCGAGTGAACACAGATGCGTGGGATGT"
        "GGTTTTAGGGTAAAGTCATTGTTCATTCAATACTCTCCGGGTAACATTCGTCTCATGAAATGCGTAAGATTTTTGTATTAATGGATCTTCTTTGACCCAATTAGGGTTTATAAGATTCTC"
        "TATTAAATTTCTTCAAAGTTTCCATCTTTGATCATATTGTTATATTTAGGGAAATTGCAAGGAAGTAGCAGATGAGTACATCGAGTGTGAACGCATGGTCTGTTTTAATCACTTTCTTTC"
        "CCTTTTTGGGTGTTTCCCTATTTCTTTCCAATTTTGGTTTTTGGTTCTTTAATTGTTTTCTTTGGCAGATTATTTTCATCGATTTAATCCTTCACAGACCAAAGGTATATAGACACGTCC"
        "TCTACAATGCAATTAATCCAGCAACTGTCAATATTCAGGTAAAAAACTATTTCAATTCAAGTTCTTGATTTCAAGCATTGCTAGTTCCTGTCTGATTCTA"
    ),
]
AFTER = 499  # bases from the start site on
MATRICES = [
    [
        [0.193256166989386, 0.294128456523198, 0.315455175957076, 0.19716020053034],
        [0.197302290032636, 0.470942977434902, 0.174991433244587, 0.156763299287876],
        [0.0179780513925291, 0.00028341348993657, 0.981568346569837, 0.000170188547697322],
        [0.0609138140456216, 0.828370054420269, 0.0864408167680766, 0.024275314766033],
        [0.0977576692954277, 0.680271275873928, 0.0761337494017287, 0.145837305428915],
        [0.179404994209844, 7.57471687865919e-05, 0.820280034450025, 0.00023922417134443],
        [0.138180576938342, 0.419289393502228, 0.212419131491284, 0.230110898068146],
        [0.223853107035285, 0.403828411802235, 0.192672154777683, 0.179646326384797],
        [0.351359490482045, 0.208890436834257, 0.230859635849441, 0.208890436834257],
    ],
    [
        [0.205689924493205, 0.280442808763306, 0.274889669089141, 0.238977597654347],
        [0.219631343095586, 0.420712804984574, 0.181626145278971, 0.178029706640869],
        [0.608066773692225, 7.42947271062653e-05, 0.391617148737412, 0.000241782843257178],
        [0.0205990864160418, 0.948846205015112, 0.0267155749296198, 0.00383913363922629],
        [0.0322894205983321, 0.911179250594626, 0.0193896543133781, 0.0371416744936642],
        [0.0648466587263899, 0.000159139418881284, 0.85579031403152, 0.0792038878232088],
        [0.352874110546702, 0.312971260238602, 0.12225528593584, 0.211899343278855],
        [0.215542593260496, 0.381136865806431, 0.150378964586948, 0.252941576346124],
        [0.319425317617637, 0.236636095450179, 0.16345267500563, 0.280485911926554],
    ],
]
VALUES = [
    [
        3.0475383834953504, 0.8608082265160828, 0.0, 2.6811952642887764, 6.2931514616547215, 10.357160220617788,
        5.8783729023403914, 7.283335981962449, 1.4621176788340868, 9.35644774476908, 10.063328108540803, 6.053999530313758,
        5.651958012678936, 2.672253788534258, 0.0874145151147534, 0.0, 5.314611426389227, 6.21408948540967,
        1.185154154528389, 7.021382586718003, 4.7535412826321775, 3.709686421870906, 4.195269350401292, 8.842669074816218,
    ],
    [
        0.0, 3.055175266170643, 2.8593467935921453, 3.348346248157913, 4.528402194317488, 20.171433068881782,
        1.3684052761180752, 5.898359346484304, 7.809001766112434, 5.11607714219352, 4.039786150246659, 10.071909110893912,
        0.4313225205708342, 2.762304602290399, 3.2299091904280903, 9.819556021562367, 6.616843587402707, 16.58724044655478,
        0.9319147728564978, 5.867066556948469, 2.6157846225115513, 7.831971458270161, 3.5009980891680925, 14.089594568382788,
    ],
]


def test_known_features(spark):
    seqs = spark.createDataFrame([(i, f"s{i}", x) for i, x in enumerate(SEQUENCES)], "seq_idx long, seq_id string, seq string")
    pwms = [Pwm(i, f"m{i}", normalise(m, 0.01)) for i, m in enumerate(MATRICES)]
    table, specs = commands.tiled_features(seqs, pwms, 500, 100, 100, 250, nucs_after_tss=AFTER)
    got = [r["values"] for r in table.orderBy("seq_idx").collect()]
    assert len(specs) == 24 and [s.feature_id for s in specs[:7]] == [*(f"m0_FWD_{k}_tile100" for k in range(1, 7)), "m1_FWD_1_tile100"]
    for have, want in zip(got, VALUES, strict=True):
        assert all(abs(a - b) <= 1e-9 * max(1, abs(b)) for a, b in zip(have, want, strict=True))
    assert features.long_features(table, specs).count() == 48
